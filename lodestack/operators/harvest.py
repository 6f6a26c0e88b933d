"""From raw responses to classified pages, and their merge into the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import status as st
from lodestack.functions.html import decode_html, page_extractor
from lodestack.functions.quality import assess
from lodestack.functions.text import char_count, content_hash, word_count
from lodestack.functions.urls import domain_of, normalize_url
from lodestack.settings import DEFAULTS, Settings
from lodestack.sources.fetching import rerendered_wins
from lodestack.sources.documents import detect_kind, extract_documents

SNIPPET = 400


def extract_pages(raw: DataFrame, s: Settings = DEFAULTS, main_content=None) -> DataFrame:
    """Fetch results (url, status_code, content_type, html, text, title, ..., crawl_status, error) of RAW rows.

    The outcome is decided in a fixed order: refused, transport failure, blocked status, error status,
    document, non-HTML, challenge, quality. Responses are parsed only where the order gets that far.
    """
    d = raw.withColumn("_kind", detect_kind(F.col("content_type"), F.col("final_url")))
    code = F.col("status_code")
    good = code.isNotNull() & (code < 400)
    page = good & st.is_html(F.col("content_type"))
    doc = good & ~st.is_html(F.col("content_type")) & F.col("_kind").isNotNull()
    d = d.withColumn("html", decode_html(F.when(page, F.substring(F.col("body"), 1, s.max_html_bytes)), F.col("content_type")))
    d = d.withColumn("_p", page_extractor(main_content)(F.col("html")))
    docs = extract_documents(d.withColumn("kind", F.when(doc, F.col("_kind"))).withColumn("content", F.when(doc, F.col("body"))).withColumnRenamed("error", "_error"))
    d = docs.withColumnsRenamed({"text": "_doc_text", "meta": "_doc_meta", "error": "_doc_error", "crawl_status": "_doc_status", "_error": "error"}).drop("kind", "content")
    text, title = F.col("_p.text"), F.col("_p.title")
    d = d.withColumn("_blocked", st.block_reason(text, title, F.col("html"), s)).withColumn("_q", assess(text, s))
    refused = code.isNull() & (F.coalesce(F.col("attempts"), F.lit(0)) == 0) & ~st.blank(F.col("error"))
    rules = [
        (refused, "SKIPPED", F.col("error")),
        (code.isNull(), "FAILED", F.when(st.blank(F.col("error")), F.lit("no response")).otherwise(F.col("error"))),
        (code.isin(*st.BLOCKED_HTTP), "BLOCKED", F.concat(F.lit("HTTP "), code.cast("string"))),
        (code >= 400, "FAILED", F.concat(F.lit("HTTP "), code.cast("string"))),
        (doc, None, F.col("_doc_error")),
        (~page, "FAILED", F.concat(F.lit("unsupported content type: "), F.coalesce("content_type", F.lit("")))),
        (F.col("_blocked") != "", "BLOCKED", F.col("_blocked")),
        (F.col("_q.ok"), "SUCCESS", F.lit("")),
        (F.lit(True), "PARTIAL", F.col("_q.reason")),
    ]
    pick = lambda values: F.coalesce(*[F.when(c, v) for (c, _, _), v in zip(rules, values)])
    state = pick([F.col("_doc_status") if name is None else F.lit(name) for _, name, _ in rules])
    shown = F.when(page & (F.col("_blocked") == ""), text).when(doc, F.col("_doc_text")).otherwise(F.lit(""))
    meta = F.when(page, F.col("_p.meta")).when(doc, F.col("_doc_meta")).otherwise(F.create_map().cast("map<string,string>"))
    meta = F.when(page & (F.col("_blocked") != ""), F.map_concat(meta, F.create_map(F.lit("blocked_snippet"), F.substring(text, 1, SNIPPET)))).otherwise(meta)
    return d.select(
        "url", "status_code", "final_url", "content_type",
        F.coalesce(F.when(page, F.col("html")), F.lit("")).alias("html"),
        shown.alias("text"),
        F.coalesce(F.when(page, title), F.lit("")).alias("title"),
        F.coalesce(F.when(page, F.col("_p.description")), F.lit("")).alias("description"),
        meta.alias("meta"),
        pick([r for _, _, r in rules]).alias("error"),
        "elapsed_ms",
        state.alias("crawl_status"),
        F.when(doc, "document").when(page, F.col("_p.method")).otherwise(F.lit("")).alias("scraping_method"),
        "attempts",
        word_count(shown).alias("word_count"),
        char_count(shown).alias("char_count"),
    )


def rerendered(results: DataFrame, rendered: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Results of one harvest with the rendered page in place of the plain one where it is good and clearly longer."""
    cols = results.columns
    other = rendered.groupBy("url").agg(F.max_by(F.struct(*cols), F.col("char_count")).alias("_r"))
    better = rerendered_wins(F.coalesce("char_count", F.lit(0)), F.col("_r.crawl_status") == "SUCCESS", F.coalesce("_r.char_count", F.lit(0)), s)
    j = results.join(other, "url", "left").withColumn("_better", better)
    return j.select(*[F.when(F.col("_better"), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def store_results(pages: DataFrame, results: DataFrame, now: F.Column | None = None) -> DataFrame:
    """The page table with the latest fetch of each normalised URL merged in; other rows stay as they are.

    Results (fetch_id, if there is one, is unique) are reduced to one for each URL before the join; metadata merges with the new value winning.
    """
    now = F.current_timestamp() if now is None else now
    r = results.withColumn("_key", normalize_url(F.col("url")))
    cols = [c for c in r.columns if c != "_key"]
    order = F.col("fetched_at") if "fetched_at" in cols else F.coalesce("attempts", F.lit(0))
    if "fetch_id" in cols:  # numbers choose the fetch; only the chosen ones' HTML and text are moved
        chosen = r.groupBy("_key").agg(F.max_by("fetch_id", order).alias("fetch_id")).select("fetch_id")
        r = r.join(chosen, "fetch_id", "left_semi")
    one = r.groupBy("_key").agg(F.max_by(F.struct(*cols), order).alias("r")) if "fetch_id" not in cols else r.select("_key", F.struct(*cols).alias("r"))
    j = pages.join(one, pages.normalized_url == one["_key"], "left")
    hit, t = F.col("r").isNotNull(), F.coalesce("r.text", F.lit(""))
    final = F.coalesce(F.nullif("r.final_url", F.lit("")), F.col("url"))
    base = F.map_filter(F.coalesce("meta_json", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("r.meta", F.create_map().cast("map<string,string>"))), k) & (k != "normalized_url"))
    fresh = F.map_filter(F.coalesce("r.meta", F.create_map().cast("map<string,string>")), lambda k, v: k != "normalized_url")
    meta = F.map_concat(base, fresh, F.create_map(F.lit("normalized_url"), F.col("normalized_url")))
    new = {
        "http_status": F.col("r.status_code"), "final_url": final, "content_type": F.coalesce("r.content_type", F.lit("")), "raw_html": F.coalesce("r.html", F.lit("")), "text_content": t,
        "title": F.coalesce("r.title", F.lit("")), "meta_description": F.coalesce("r.description", F.lit("")), "fetched_at": now, "updated_at": now, "fetch_ms": F.col("r.elapsed_ms"),
        "error": F.coalesce("r.error", F.lit("")), "content_hash": content_hash(t), "crawl_status": F.col("r.crawl_status"), "scraping_method": F.coalesce("r.scraping_method", F.lit("")),
        "char_count": F.coalesce(F.nullif("r.char_count", F.lit(0)), F.length(t)), "word_count": F.coalesce(F.nullif("r.word_count", F.lit(0)), word_count(t)), "domain": domain_of(final),
        "meta_json": meta, "canonical_url": F.coalesce(F.element_at(meta, F.lit("canonical")), F.lit("")),
    }
    return j.select(*[F.when(hit, new[c]).otherwise(pages[c]).alias(c) if c in new else pages[c] for c in pages.columns])


def reextract(pages: DataFrame, s: Settings = DEFAULTS, main_content=None) -> DataFrame:
    """Rebuilds text and everything derived from it from the stored HTML, without fetching."""
    p = page_extractor(main_content)(F.col("raw_html"))
    d = pages.withColumn("_p", F.when(~st.blank(F.col("raw_html")), p)).withColumn("_q", assess(F.col("_p.text"), s))
    has = F.col("_p").isNotNull()
    state = F.when(F.col("_q.ok"), "SUCCESS").otherwise("PARTIAL")
    new = {
        "text_content": F.col("_p.text"), "title": F.col("_p.title"), "meta_description": F.col("_p.description"), "scraping_method": F.col("_p.method"),
        "content_hash": content_hash(F.col("_p.text")), "char_count": F.col("_q.char_count"), "word_count": F.col("_q.word_count"),
        "crawl_status": F.when(F.col("crawl_status").isin(*st.USABLE), state).otherwise(F.col("crawl_status")), "error": F.when(F.col("crawl_status").isin(*st.USABLE), F.col("_q.reason")).otherwise(F.col("error")),
    }
    return d.select(*[F.when(has, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in pages.columns])


def backfill(pages: DataFrame) -> DataFrame:
    """Fills crawl_status (fetched rows), char_count and domain of rows from before these columns existed."""
    return pages.withColumns({
        "crawl_status": F.when(F.col("fetched_at").isNotNull(), st.backfill_status(F.col("http_status"), F.col("text_content"), F.col("error"))).otherwise(F.col("crawl_status")),
        "char_count": F.when(F.coalesce("char_count", F.lit(0)) == 0, F.coalesce(F.length("text_content"), F.lit(0))).otherwise(F.col("char_count")),
        "domain": F.when(st.blank(F.col("domain")), domain_of(F.col("url"))).otherwise(F.col("domain")),
    })
