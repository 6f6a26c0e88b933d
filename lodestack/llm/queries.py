"""The registered queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import body, mixing, names, residue, site_lines, spans, survivors, tokens
from lodestack.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "harvested_urls")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def queries() -> dict[str, Query]:
    people = lambda s, d: (table(s, d, "extracted_people"), table(s, d, "sheet_rows"))
    return {
        "p1_found": lambda s, d: names.linked_pairs(*people(s, d)),
        "p1_groups": lambda s, d: names.linked_groups(*people(s, d)),
        "p2_found": lambda s, d: body.furniture_lines(_pages(s, d)),
        "p2_bodies": lambda s, d: body.page_bodies(_pages(s, d)),
        "p3_found": lambda s, d: site_lines.repeated_lines(_pages(s, d)),
        "p3_blocks": lambda s, d: site_lines.line_blocks(_pages(s, d)),
        "p3_clean": lambda s, d: site_lines.without_repeated_lines(_pages(s, d)),
        "p4_found": lambda s, d: residue.residue_rows(table(s, d, "fetch_results"), _pages(s, d)).select("table_name", "row_id"),
        "p4_reasons": lambda s, d: residue.residue_rows(table(s, d, "fetch_results"), _pages(s, d)),
        "p5_found": lambda s, d: survivors.surviving_ids(table(s, d, "person_records")),
        "p5_fused": lambda s, d: survivors.fused(table(s, d, "person_records"), _pages(s, d)),
        "p6_ids": lambda s, d: tokens.encode_corpus(_docs(s, d)),
        "p7_mix": lambda s, d: mixing.mixture(_docs(s, d), table(s, d, "source_weights")),
        "p7_shares": lambda s, d: mixing.shares(_docs(s, d), table(s, d, "source_weights")),
        "p8_found": lambda s, d: spans.shared_pairs(_docs(s, d)),
        "p8_shared": lambda s, d: spans.shared_report(_docs(s, d)),
        "p8_clean": lambda s, d: spans.shared_clean(_docs(s, d)),
    }


def _survivors_sql() -> str:
    """The survivors' order over the same patterns, which this SQL's engine reads without the Unicode flag."""
    plain = lambda p: p.replace("(?iu)", "(?i)").replace("(?u)", "").replace("'", "''")
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in survivors.STAND_INS)
    said = lambda c: f"trim(regexp_replace({c}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
    gone = lambda c: f"({c} IS NULL OR lower({said(c)}) IN ({quoted}) OR regexp_replace(lower({said(c)}), '[.!:]+$', '') IN ({quoted}))"
    cut_mark = lambda c: f"regexp_matches({said(c)}, '{plain(survivors.CUT_MARK)}')"
    title = f"({cut_mark('title')} OR regexp_matches({said('title')}, '{plain(survivors.OPEN_END)}') OR regexp_matches({said('title')}, '{plain(survivors.STUMP)}'))"
    bio = f"({cut_mark('bio')} OR NOT regexp_matches({said('bio')}, '{plain(survivors.SENTENCE_CLOSE)}') OR regexp_matches({said('bio')}, '{plain(survivors.DOTTED_END)}'))"
    order = "c DESC NULLS LAST, extracted_at DESC NULLS LAST, id"
    best = lambda c, broken: f"SELECT person_key, id FROM (SELECT person_key, id, row_number() OVER (PARTITION BY person_key ORDER BY {broken}, {order}) AS rn FROM r WHERE NOT {gone(c)}) WHERE rn = 1"
    return f"""
        WITH r AS (SELECT *, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS c FROM person_records WHERE person_key IS NOT NULL),
        n AS (SELECT person_key FROM r GROUP BY person_key HAVING count(*) >= 2), t AS ({best("title", title)}), b AS ({best("bio", bio)}),
        k AS (SELECT person_key, id FROM (SELECT person_key, id, row_number() OVER (PARTITION BY person_key ORDER BY {order}) AS rn FROM r WHERE c IS NOT NULL) WHERE rn = 1)
        SELECT n.person_key, coalesce(t.id, 0) AS title_id, coalesce(b.id, 0) AS bio_id, coalesce(k.id, 0) AS confidence_id
        FROM n LEFT JOIN t ON n.person_key = t.person_key LEFT JOIN b ON n.person_key = b.person_key LEFT JOIN k ON n.person_key = k.person_key"""


def oracle_sql() -> dict[str, str]:
    site = "regexp_replace(lower(regexp_extract(normalized_url, '^[^:/?#]+://([^/?#:]*)', 1)), '^www\\.', '')"
    lines = f"""
        WITH l AS (
          SELECT id, {site} AS site, unnest(generate_series(1, len(string_split(text_content, chr(10))))) AS n, string_split(text_content, chr(10)) AS x
          FROM harvested_urls WHERE text_content <> ''
        ), k AS (SELECT id, site, n, regexp_replace(lower(x[n]), '[^\\p{{L}}]+', '', 'g') AS key FROM l),
        f AS (SELECT site, key FROM k WHERE key <> '' AND site <> '' GROUP BY site, key HAVING count(DISTINCT id) >= {site_lines.MIN_PAGES})"""
    clean = """
        , g AS (SELECT k.id, list(k.n) AS gone FROM k JOIN f ON k.site = f.site AND k.key = f.key GROUP BY k.id)
        SELECT h.id, array_to_string(list_filter(string_split(h.text_content, chr(10)), lambda v, i: NOT list_contains(coalesce(g.gone, []), i)), chr(10)) AS clean_text,
               CAST(coalesce(len(g.gone), 0) AS INTEGER) AS removed_lines FROM harvested_urls h LEFT JOIN g ON h.id = g.id"""
    n = spans.MIN_SPAN
    grams = f"""
        WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= {n}),
        g AS (SELECT DISTINCT doc_id, md5_number(substring(text, i, {n})) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - {n - 1})) AS i FROM d)),
        r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), k AS (SELECT g.* FROM g JOIN r ON g.h = r.h)
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id"""
    return {"p8_found": grams, "p3_clean": lines + clean, "p5_found": _survivors_sql(), "p3_found": lines + " SELECT k.id AS id, CAST(k.n AS INTEGER) AS line_no FROM k JOIN f ON k.site = f.site AND k.key = f.key"}
