"""All registered queries of the core library and the SQL they are held against."""

from __future__ import annotations

from lodestack.plans import page_queries, table_queries


def flagship(spark, sf_dir):
    """Every logged question against the whole knowledge base: chunks, vectors, exact search, pages."""
    return table_queries.kb_search(spark, sf_dir)


def queries():
    return {**page_queries.queries(), **table_queries.queries()}


def oracle_sql():
    return {**page_queries.oracle_sql(), **table_queries.oracle_sql()}
