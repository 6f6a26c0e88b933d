"""Table schemas, additive upgrades and key assertions of the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "upload_batches": "id long, original_filename string, stored_path string, uploaded_at timestamp, row_count int, url_count int, skipped_rows int, url_column string, headers array<string>, rejected_json map<string,int>, status string, notes string",
    "harvest_jobs": "id long, batch_id long, kind string, status string, total int, processed int, succeeded int, failed int, message string, traceback string, started_at timestamp, finished_at timestamp",
    "harvested_urls": "id long, batch_id long, url string, normalized_url string, canonical_url string, domain string, http_status int, final_url string, content_type string, crawl_status string, scraping_method string, crawl_depth int, parent_url string, raw_html string, text_content string, title string, meta_description string, meta_json map<string,string>, char_count int, word_count int, created_at timestamp, fetched_at timestamp, updated_at timestamp, fetch_ms int, error string, content_hash string, indexed_hash string, chunk_count int, person_count int",
    "chunks": "id long, url_id long, ordinal int, text string, char_start int, char_end int, heading string, embedding_model string, indexed_at timestamp, index_version string",
    "person_records": "id long, url_id long, batch_id long, name string, title string, company string, location string, email string, phone string, linkedin_url string, bio string, source_chunk_ids array<long>, confidence double, raw_json string, extracted_at timestamp",
    "index_meta": "id long, index_version string, dim int, model_name string, vector_count long, built_at timestamp, path string",
    "search_queries": "id long, query string, top_k int, result_count int, latency_ms int, llm_used boolean, provider string, created_at timestamp",
    "fetch_results": "url string, status_code int, final_url string, content_type string, html string, text string, title string, description string, meta map<string,string>, error string, elapsed_ms int, crawl_status string, scraping_method string, word_count int, char_count int",
    "vectors": "chunk_id long, embedding array<double>",
}
UNIQUE = {
    "harvested_urls": ("batch_id", "normalized_url"),
    "chunks": ("url_id", "ordinal"),
    "person_records": ("url_id", "name", "title"),
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def sync_columns(df: DataFrame, name: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Adds the columns that a table of an older version lacks; extra columns are kept at the end.

    A missing text column becomes "", a missing number 0 unless `defaults` says otherwise, others null.
    """
    zero = {"string": "", "int": 0, "bigint": 0}
    have = set(df.columns)
    add = {}
    for f in schema(name):
        if f.name not in have:
            kind = f.dataType.simpleString()
            value = (defaults or {}).get(f.name, zero.get(kind))
            add[f.name] = F.lit(value).cast(f.dataType)
    df = df.withColumns(add) if add else df
    order = [f.name for f in schema(name)]
    return df.select(*order, *[c for c in df.columns if c not in order])


def key_violations(df: DataFrame, name: str) -> DataFrame:
    """Key values that occur more than once; an empty result is the uniqueness assertion."""
    keys = UNIQUE[name]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def deduplicate(df: DataFrame, name: str, order: str = "id") -> DataFrame:
    """The row with the least `order` of each key, by one aggregation with map-side combine."""
    keys = UNIQUE[name]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)
