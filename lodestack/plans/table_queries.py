"""Queries over listings, vectors, search and people, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import people as pf
from lodestack.functions import text
from lodestack.functions.vectors import unit
from lodestack.operators import answers, index, listing, log, records, search
from lodestack.session import table
from lodestack.settings import Settings
from lodestack.sources import fetching

#: The query set of the vector queries: every row whose id is divisible by this, against all rows.
EVERY = 20
K = 8


def _t(name):
    return lambda s, d: table(s, d, name)


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), unit(F.col("embedding")).alias("embedding"))


def _hits(s, d, k):
    v = _vectors(s, d)
    return search.exact_topk(v, v.filter(F.pmod("chunk_id", F.lit(EVERY)) == 0).withColumnRenamed("chunk_id", "query_id"), k, round_to=4)


def _labelled(s, d, settings=Settings()):
    """Threshold or fallback over 4 k hits, with the label standing for the page."""
    hits = search.threshold_or_best(_hits(s, d, K * settings.overfetch), settings)
    return hits.join(table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("page_key")), "chunk_id")


def knowledge_base(s, d):
    """(chunks, vectors) of all pages with text."""
    chunks = index.make_chunks(table(s, d, "harvested_urls"))
    return chunks, index.make_vectors(chunks)


def questions(s, d):
    """The logged questions, each id once."""
    return log.deduplicated(table(s, d, "search_queries").select("id", "query", "created_at")).select(F.col("id").alias("query_id"), "query")


def kb_search(s, d):
    """Every distinct logged question against the whole knowledge base."""
    chunks, vectors = knowledge_base(s, d)
    asked = questions(s, d).groupBy("query").agg(F.min("query_id").alias("query_id")).select("query_id", "query")
    pages = table(s, d, "harvested_urls").select("id", "normalized_url", "url", "title")
    r = search.search(asked, chunks.select("chunk_id", "url_id"), vectors, pages)
    return r.select("query_id", "query", "page_key", "page_rank", "score", "chunk_id", "url_id", "url", "title", "relevant", "note")


#: An answer that cites pages in several ways, one of them unknown.
ANSWER = "Both [2] and 【1†L3-L9】 say so, [90] does not; see [2] and [3]."
ROBOTS = [
    (1, "User-agent: *\nDisallow: /private/", 200, "https://a.example/private/x", False),
    (2, "User-agent: *\nDisallow: /private/", 200, "https://a.example/open", True),
    (3, "User-agent: *\nDisallow: /", 503, "https://b.example/x", True),
    (4, None, None, "https://c.example/x", True),
    (5, "User-agent: *\nDisallow:", 200, "https://d.example/x", True),
    (6, "User-agent: other\nDisallow: /", 200, "https://e.example/x", True),
    (7, "User-agent: lodestack\nDisallow: /a\nAllow: /", 200, "https://f.example/a/b", False),
]


def results(s, d):
    """Search results for the answer queries: each batch asks, its first eight pages answer with their description."""
    first = F.row_number().over(Window.partitionBy("batch_id").orderBy("id"))
    text_of = lambda c: F.coalesce(c, F.lit(""))
    r = table(s, d, "harvested_urls").filter("batch_id is not null").select("id", "batch_id", "url", "title", "meta_description").withColumn("page_rank", first).filter("page_rank <= 8")
    chunk = F.struct(F.col("id").alias("chunk_id"), F.lit(1.0).alias("score"), F.struct(F.lit("").alias("heading"), text_of(F.col("meta_description")).alias("text")).alias("payload"))
    return r.select(F.col("batch_id").alias("query_id"), "page_rank", F.col("id").alias("url_id"), text_of(F.col("title")).alias("title"), text_of(F.col("url")).alias("url"), F.array(chunk).alias("matched_chunks"), (F.col("page_rank") <= 3).alias("relevant"))


def _with_people(s, d):
    return search.attach_people(results(s, d), table(s, d, "person_records").select("id", "url_id", "name", "title", "company", "confidence"))


def _cards(s, d):
    r = _with_people(s, d)
    asked = r.filter("page_rank = 1").select("query_id", F.concat(F.lit("Who is "), "title").alias("query"), F.lit("").alias("answer"))
    return search.rank_people(r.select("query_id", "page_rank", "people").join(asked, "query_id"))


def robots_gate(s, d):
    rows = s.createDataFrame([r[:4] for r in ROBOTS], "row_id int, rules string, status int, url string")
    return rows.select("row_id", fetching.robots_allowed("lodestack")("rules", "status", "url").alias("allowed"))


def _model(s, d):
    return records.coerce(table(s, d, "person_records").withColumn("pos", F.col("id"))).filter("url_id is not null")


def _pattern(s, d):
    return records.coerce(table(s, d, "extracted_people").withColumn("pos", F.col("record_id")).withColumn("email", F.lit("")))


def queries():
    people, pages, jobs = _t("person_records"), _t("harvested_urls"), _t("harvest_jobs")
    return {
        "list_urls": lambda s, d: listing.page_listing(pages(s, d), "-fetched_at", 2, 25, q="news").select("id", "url", "crawl_status", "html_length", "text_length", "status_label"),
        "list_urls_status": lambda s, d: listing.page_listing(pages(s, d), "http_status", 1, 200, has_error=True, status="FAILED").select("id", "http_status", "error"),
        "list_urls_count": lambda s, d: listing.page_count(pages(s, d), 25, q="news", has_error=False),
        "list_people": lambda s, d: listing.people_listing(people(s, d), pages(s, d), q="chief").select("id", "name", "title", "company", "source_url"),
        "crawl_counts": lambda s, d: listing.crawl_counts(pages(s, d), ["batch_id"]),
        "table_counts": lambda s, d: listing.table_counts(batches=_t("upload_batches")(s, d), people=people(s, d), searches=_t("search_queries")(s, d), urls=pages(s, d)),
        "job_listing": lambda s, d: listing.job_listing(jobs(s, d)).select("id", "kind", "status", "percent"),
        "jobs_active": lambda s, d: listing.job_listing(jobs(s, d), active_only=True).select("id", "status"),
        "jobs_failed_orphans": lambda s, d: listing.fail_orphans(jobs(s, d)).select("id", "status"),
        "batches_latest": lambda s, d: listing.batch_listing(_t("upload_batches")(s, d), 10).select("id", "original_filename", "row_count"),
        "searches_recent": lambda s, d: listing.recent_searches(log.deduplicated(_t("search_queries")(s, d)), 10).select("id", "query", "top_k"),
        "search_log_once": lambda s, d: log.deduplicated(_t("search_queries")(s, d)).groupBy("provider").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("result_count").alias("n_results")),
        "person_counts": lambda s, d: records.counts_on_pages(pages(s, d).select("id", "url"), people(s, d), "url_id", "people").select("id", "people"),
        "batch_deleted": lambda s, d: listing.delete_batch(1, pages(s, d), pages(s, d).select(F.col("id").alias("url_id")), people(s, d))[2].select("id", "url_id", "batch_id"),
        # vectors
        "vec_topk": lambda s, d: search.exact_topk(_vectors(s, d), _vectors(s, d).filter("chunk_id = 0").withColumnRenamed("chunk_id", "query_id"), 10, 4),
        "vec_topk_multi": lambda s, d: _hits(s, d, K),
        "vec_threshold_fallback": lambda s, d: search.threshold_or_best(_hits(s, d, 32), Settings(search_min_score=0.9)).select("query_id", "chunk_id", "score", "rank", "low_confidence"),
        "vec_grouped_topk": lambda s, d: search.group_by_page(_labelled(s, d)).select("query_id", "page_key", "score", "chunk_id", "page_rank", F.size("matched_chunks").alias("n_chunks")),
        "vec_relevance_gate": lambda s, d: search.relevance_gate(search.group_by_page(_labelled(s, d))).select("query_id", "page_key", "score", "relevant"),
        "vec_upsert": lambda s, d: index.upsert(_vectors(s, d), _vectors(s, d).filter("chunk_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)), "chunk_id").select("chunk_id", F.round(F.col("embedding")[0], 6).alias("first_value")),
        "vec_remove": lambda s, d: index.remove(_vectors(s, d), _vectors(s, d).filter("chunk_id % 7 = 0"), "chunk_id").select("chunk_id"),
        "index_describe": lambda s, d: index.describe(_vectors(s, d)).select("type", "metric", "dim", "vectors", "persisted"),
        "index_integrity": lambda s, d: index.integrity(_vectors(s, d).select("chunk_id"), _vectors(s, d).filter("chunk_id <> 5")),
        "kb_search": kb_search,
        # answers
        "answer_context": lambda s, d: answers.build_context(answers.context_slots(results(s, d))),
        "cited_sources": lambda s, d: answers.cited_sources(results(s, d).select("query_id", F.lit(ANSWER).alias("answer")).distinct(), answers.context_slots(results(s, d))),
        "attach_people": lambda s, d: _with_people(s, d).select("query_id", "url_id", F.size("people").alias("n_people"), F.array_join(F.transform("people", lambda p: F.coalesce(p["name"], F.lit(""))), "|").alias("names")),
        "rank_people": lambda s, d: _cards(s, d).select("query_id", "rank", "named", "name", "title"),
        "robots_gate": robots_gate,
        # people
        "extract_people": lambda s, d: pf.extract_people(pages(s, d)).select("url_id", "rank", "name", "title", "company", "confidence", "evidence"),
        "best_per_name": lambda s, d: records.best_per_name(_t("extracted_people")(s, d).select("record_id", "url_id", "name", "title"), "url_id", "name", "title", "record_id").select("url_id", "record_id", "name", "title"),
        "merge_records": lambda s, d: records.merge_records(_model(s, d), _pattern(s, d)).select("url_id", "rank", "name", "title", "company", "bio", "confidence"),
        "person_pages": lambda s, d: records.link_chunks(people(s, d).select("id", "url_id", "name"), pages(s, d).filter("text_content <> ''").select(F.col("id").alias("url_id"), F.col("id").alias("chunk_id"), F.col("text_content").alias("text"))).select("id", F.size("source_chunk_ids").alias("n_chunks")),
        "infer_company": lambda s, d: pages(s, d).select("id", pf.infer_company(F.lit(""), F.col("normalized_url")).alias("company")),
        "page_company": lambda s, d: pages(s, d).select("id", pf.infer_company(F.col("text_content"), F.col("normalized_url")).alias("company")),
        "confidence_clamp": lambda s, d: people(s, d).select("id", text.clamp_unit(F.get_json_object("raw_json", "$.pass")).alias("confidence")),
        "citations": lambda s, d: _t("documents")(s, d).select("doc_id", F.array_join(text.citations(F.col("text")).cast("array<string>"), ",").alias("cited")).filter("cited <> ''"),
    }


_RESULTS = "WITH r AS (SELECT batch_id AS query_id, id AS url_id, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS n, coalesce(title, '') AS title, coalesce(url, '') AS url, coalesce(meta_description, '') AS t FROM harvested_urls WHERE batch_id IS NOT NULL QUALIFY n <= 8)"
_NORM = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings"
_SCORES = f"""WITH v AS ({_NORM}), s AS (
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label, round(list_dot_product(a.e, b.e) / (a.n * b.n), 4) AS score FROM v a, v b WHERE {{where}}),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s)"""
_MULTI = _SCORES.format(where=f"a.vec_id % {EVERY} = 0")
_GROUPED = (
    _MULTI
    + """, h AS (SELECT *, max(score) OVER (PARTITION BY query_id) >= 0.25 AS any_pass FROM r WHERE rank <= 32),
    k AS (SELECT * FROM h WHERE CASE WHEN any_pass THEN score >= 0.25 ELSE rank <= 8 END),
    g AS (SELECT query_id, label AS page_key, max(score) AS score, arg_min(chunk_id, rank) AS chunk_id, CAST(least(3, count(*)) AS INTEGER) AS n_chunks FROM k GROUP BY 1, 2),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_key) AS INTEGER) AS page_rank FROM g),
    t AS (SELECT * FROM p WHERE page_rank <= 8)"""
)


def _blank(alias: str, col: str) -> str:
    return f"regexp_replace(coalesce({alias}.{col}, ''), '^\\s+|\\s+$', '', 'g')"


def oracle_sql():
    merge_fields = ("name", "title", "company", "bio")
    from lodestack.plans.sql_parts import domain, strip

    src = lambda t, pos: f"SELECT url_id, {pos} AS pos, " + ", ".join(f"{strip(c)} AS {c}" for c in merge_fields) + f", CASE WHEN confidence IS NULL OR isnan(confidence) THEN NULL ELSE greatest(0.0, least(1.0, confidence)) END AS confidence FROM {t} WHERE url_id IS NOT NULL"
    fill = lambda c: f"coalesce(nullif(m.{c}, ''), p.{c}, '') AS {c}"
    return {
        "list_urls": "SELECT id, url, crawl_status, CAST(coalesce(length(raw_html), 0) AS INTEGER) AS html_length, CAST(coalesce(length(text_content), 0) AS INTEGER) AS text_length, CASE crawl_status WHEN 'SUCCESS' THEN 'Crawled' WHEN 'PARTIAL' THEN 'Partial content' WHEN 'BLOCKED' THEN 'Blocked by site' WHEN 'FAILED' THEN 'Failed' WHEN 'SKIPPED' THEN 'Skipped' WHEN 'PENDING' THEN 'Queued' WHEN 'PROCESSING' THEN 'Crawling' ELSE coalesce(crawl_status, '') END AS status_label FROM harvested_urls WHERE url ILIKE '%news%' OR title ILIKE '%news%' ORDER BY fetched_at DESC NULLS LAST, id DESC LIMIT 25 OFFSET 25",
        "list_urls_status": "SELECT id, http_status, error FROM harvested_urls WHERE error <> '' AND crawl_status = 'FAILED' ORDER BY http_status NULLS FIRST, id LIMIT 200",
        "list_urls_count": "SELECT count(*) AS count, CAST((count(*) + 24) // 25 AS BIGINT) AS pages FROM harvested_urls WHERE error = '' AND (url ILIKE '%news%' OR title ILIKE '%news%')",
        "list_people": "SELECT p.id, p.name, p.title, p.company, h.url AS source_url FROM person_records p JOIN harvested_urls h ON p.url_id = h.id WHERE p.name ILIKE '%chief%' OR p.title ILIKE '%chief%' OR p.company ILIKE '%chief%' OR p.bio ILIKE '%chief%' ORDER BY p.name NULLS FIRST, p.id LIMIT 100",
        "crawl_counts": "SELECT batch_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (coalesce(crawl_status, 'PENDING') = '{k.upper()}') AS {k}" for k in ("success", "partial", "blocked", "failed", "pending")) + " FROM harvested_urls GROUP BY batch_id",
        "table_counts": "SELECT 'batches' AS name, count(*) AS n_rows FROM upload_batches UNION ALL SELECT 'people', count(*) FROM person_records UNION ALL SELECT 'searches', count(*) FROM search_queries UNION ALL SELECT 'urls', count(*) FROM harvested_urls",
        "job_listing": "SELECT id, kind, status, CAST(CASE WHEN coalesce(total, 0) = 0 THEN CASE WHEN status = 'success' THEN 100 ELSE 0 END ELSE least(100, floor(coalesce(processed, 0) * 1.0 / total * 100)) END AS INTEGER) AS percent FROM harvest_jobs ORDER BY id DESC LIMIT 50",
        "jobs_active": "SELECT id, status FROM harvest_jobs WHERE status IN ('running', 'queued') ORDER BY id DESC LIMIT 50",
        "jobs_failed_orphans": "SELECT id, CASE WHEN status IN ('running', 'queued') THEN 'failed' ELSE status END AS status FROM harvest_jobs",
        "batches_latest": "SELECT id, original_filename, row_count FROM upload_batches ORDER BY uploaded_at DESC NULLS LAST, id DESC LIMIT 10",
        "searches_recent": "SELECT id, query, top_k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM search_queries) WHERE rn = 1 ORDER BY id DESC LIMIT 10",
        "search_log_once": "SELECT provider, count(*) AS n_queries, CAST(sum(result_count) AS BIGINT) AS n_results FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM search_queries) WHERE rn = 1 GROUP BY provider",
        "person_counts": "SELECT h.id, CAST(count(p.id) AS INTEGER) AS people FROM harvested_urls h LEFT JOIN person_records p ON p.url_id = h.id GROUP BY h.id",
        "batch_deleted": "SELECT id, url_id, CASE WHEN batch_id <> 1 THEN batch_id END AS batch_id FROM person_records WHERE url_id IS NULL OR url_id NOT IN (SELECT id FROM harvested_urls WHERE batch_id = 1)",
        "answer_context": _RESULTS + " SELECT query_id, string_agg('[' || n || '] ' || title || chr(10) || 'URL: ' || url || chr(10) || t, chr(10) || chr(10) ORDER BY n) AS context FROM r WHERE n <= 6 GROUP BY query_id",
        "cited_sources": _RESULTS + ", c AS (SELECT * FROM (VALUES (0, 2), (1, 1), (2, 90), (3, 3)) AS v(pos, cited)), f AS (SELECT r.query_id, c.pos, c.cited, r.url, r.title, row_number() OVER (PARTITION BY r.query_id, r.url ORDER BY c.pos) AS k FROM r JOIN c ON r.n = c.cited) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS source_rank, cited, url, title FROM f WHERE k = 1",
        "attach_people": _RESULTS + " SELECT r.query_id, r.url_id, CAST(count(p.id) AS INTEGER) AS n_people, coalesce(string_agg(coalesce(p.name, ''), '|' ORDER BY coalesce(p.confidence, 0) DESC, p.id), '') AS names FROM r LEFT JOIN person_records p ON p.url_id = r.url_id AND r.n <= 3 GROUP BY r.query_id, r.url_id",
        "rank_people": _RESULTS + """, e AS (SELECT r.query_id, r.n, p.name, p.title, row_number() OVER (PARTITION BY r.query_id, r.n ORDER BY coalesce(p.confidence, 0) DESC, p.id) AS pos FROM r JOIN person_records p ON p.url_id = r.url_id AND r.n <= 3),
            o AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(coalesce(name, '')), lower(coalesce(title, '')) ORDER BY n, pos) AS k FROM e),
            h AS (SELECT query_id, lower(trim(regexp_replace('Who is ' || title || chr(10), '\\s+', ' ', 'g'))) AS hay FROM r WHERE n = 1),
            m AS (SELECT o.*, lower(trim(regexp_replace(coalesce(o.name, ''), '\\s+', ' ', 'g'))) AS low, h.hay FROM o JOIN h ON o.query_id = h.query_id WHERE k = 1),
            g AS (SELECT *, contains(low, ' ') AND contains(hay, low) AS named FROM m), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY named DESC, n, pos) AS INTEGER) AS rank FROM g)
            SELECT query_id, rank, named, name, title FROM q WHERE rank <= 12""",
        "robots_gate": "SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, {str(r[4]).lower()})" for r in ROBOTS) + ") AS v(row_id, allowed)",
        "vec_topk": _SCORES.format(where="a.vec_id = 0") + " SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10",
        "vec_topk_multi": _MULTI + f" SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= {K}",
        "vec_threshold_fallback": _MULTI + ", h AS (SELECT *, max(score) OVER (PARTITION BY query_id) >= 0.9 AS any_pass FROM r WHERE rank <= 32) SELECT query_id, chunk_id, score, rank, NOT any_pass AS low_confidence FROM h WHERE CASE WHEN any_pass THEN score >= 0.9 ELSE rank <= 8 END",
        "vec_grouped_topk": _GROUPED + " SELECT query_id, page_key, score, chunk_id, page_rank, n_chunks FROM t",
        "vec_relevance_gate": _GROUPED + " SELECT query_id, page_key, score, score >= greatest(max(score) OVER (PARTITION BY query_id) * 0.75, 0.25) AS relevant FROM t",
        "vec_upsert": f"WITH v AS ({_NORM}) SELECT vec_id AS chunk_id, round(CASE WHEN vec_id % 3 = 0 THEN -e[1] / n ELSE e[1] / n END, 6) AS first_value FROM v",
        "vec_remove": "SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 7 <> 0",
        "index_describe": "SELECT 'flat' AS type, 'inner_product' AS metric, CAST(max(len(embedding)) AS INTEGER) AS dim, count(*) AS vectors, false AS persisted FROM embeddings",
        "index_integrity": "SELECT CAST(5 AS BIGINT) AS chunk_id, 'no vector' AS problem",
        "best_per_name": "SELECT url_id, record_id, name, title FROM (SELECT *, row_number() OVER (PARTITION BY url_id, lower(name) ORDER BY coalesce(length(title), 0) DESC, record_id) AS rn FROM extracted_people) WHERE rn = 1",
        "merge_records": f"""WITH m0 AS ({src('person_records', 'id')}), p0 AS ({src('extracted_people', 'record_id')}),
            m AS (SELECT *, min(pos) OVER (PARTITION BY url_id, lower(name)) AS mp, row_number() OVER (PARTITION BY url_id, lower(name) ORDER BY pos DESC) AS rn FROM m0 WHERE name <> ''),
            p AS (SELECT *, row_number() OVER (PARTITION BY url_id, lower(name) ORDER BY pos) AS rn FROM p0 WHERE name <> ''),
            j AS (SELECT coalesce(m.url_id, p.url_id) AS url_id, m.url_id IS NULL AS only_p, coalesce(m.mp, p.pos) AS ord, lower(coalesce(m.name, p.name)) AS k, {", ".join(fill(c) for c in merge_fields)},
                  CASE WHEN coalesce(m.confidence, 0) <> 0 THEN m.confidence ELSE coalesce(p.confidence, m.confidence) END AS confidence
                  FROM (SELECT * FROM m WHERE rn = 1) m FULL OUTER JOIN (SELECT * FROM p WHERE rn = 1) p ON m.url_id = p.url_id AND lower(m.name) = lower(p.name))
            SELECT url_id, CAST(row_number() OVER (PARTITION BY url_id ORDER BY only_p, ord, k) AS INTEGER) AS rank, name, title, company, bio, confidence FROM j""",
        "person_pages": "SELECT p.id, CAST(count(h.id) AS INTEGER) AS n_chunks FROM person_records p LEFT JOIN harvested_urls h ON p.url_id = h.id AND h.text_content <> '' AND p.name <> '' AND contains(lower(h.text_content), lower(p.name)) GROUP BY p.id",
        "infer_company": f"SELECT id, CASE WHEN d = '' THEN '' ELSE upper(substring(split_part(d, '.', 1), 1, 1)) || lower(substring(split_part(d, '.', 1), 2)) END AS company FROM (SELECT id, {domain('normalized_url')} AS d FROM harvested_urls)",
        "confidence_clamp": "SELECT id, CASE WHEN c IS NOT NULL THEN greatest(0.0, least(1.0, c)) END AS confidence FROM (SELECT id, try_cast(regexp_extract(coalesce(raw_json, ''), '\"pass\": *([-0-9.eE]+)', 1) AS DOUBLE) AS c FROM person_records)",
        "citations": "SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[\\[【]([0-9]+)[^\\]】]*[\\]】]', 1), ',') AS cited FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[\\[【]([0-9]+)[^\\]】]*[\\]】]', 1)) > 0",
    }
