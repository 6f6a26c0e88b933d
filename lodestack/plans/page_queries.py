"""Queries over URLs, texts, pages and fetches, with their oracles where SQL can say the same."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import functions as F

from lodestack.functions import guard, html, links, people, quality, text, urls
from lodestack.functions import status as st
from lodestack.operators import crawl, harvest, index, upload
from lodestack.plans import sql_parts as q
from lodestack.session import table
from lodestack.sources.documents import detect_kind


def _h(s, d):
    return table(s, d, "harvested_urls")


def _sheet(s, d):
    return upload.classify_rows(table(s, d, "sheet_rows"), "url", "row_id", ["batch_id"])


def _keywords() -> str:
    rows = [(i, w, base - j, inner - j) for i, (w, base, inner, j) in enumerate([(w, 100, 60, j) for j, w in enumerate(links.HIGH)] + [(w, 50, 15, j) for j, w in enumerate(links.MEDIUM)])]
    return ", ".join(f"({i}, '{w}', {a}, {b})" for i, w, a, b in rows)


_CLASSIFIED = f"""
    WITH r AS (SELECT row_id, batch_id, {q.strip('url')} AS raw FROM sheet_rows),
    c AS (SELECT *, CASE WHEN raw = '' THEN NULL WHEN regexp_matches(raw, '(?i)^https?://\\S+$') THEN raw
                     WHEN contains(raw, '.') AND NOT contains(raw, ' ') THEN 'https://' || regexp_replace(raw, '^/+', '') END AS cand FROM r),
    h AS (SELECT *, CASE WHEN cand IS NULL THEN NULL ELSE {q.host('cand')} END AS host FROM c),
    g AS (SELECT *, CASE WHEN cand IS NULL THEN NULL WHEN host = '' THEN 'no host in URL'
                     WHEN regexp_matches({q.part('cand', 2)}, '@') THEN 'credentials in URL are not accepted' ELSE '' END AS refused FROM h),
    n AS (SELECT *, CASE WHEN refused = '' THEN {q.dedup_key('trim(cand)')} END AS norm FROM g),
    o AS (SELECT *, CASE WHEN norm IS NULL THEN NULL ELSE min(row_id) OVER (PARTITION BY batch_id, norm) END AS first_id FROM n),
    b AS (SELECT row_id, batch_id, cand, norm,
          CASE WHEN raw = '' THEN 'blank' WHEN cand IS NULL THEN 'invalid' WHEN refused <> '' THEN 'rejected' WHEN row_id > first_id THEN 'duplicate' ELSE 'valid' END AS bucket,
          CASE WHEN raw = '' THEN 'empty value' WHEN cand IS NULL THEN 'not a URL' WHEN refused <> '' THEN refused WHEN row_id > first_id THEN 'duplicate URL in this file' ELSE '' END AS reason FROM o)"""

_LINKS = f"""
    WITH k(ord, w, clean, inner_s) AS (VALUES {_keywords()}),
    lo(ord, w) AS (VALUES {", ".join(f"({i}, '{w}')" for i, w in enumerate(links.LOW))}),
    u AS (SELECT id, replace(lower({q.part('url', 3)}), '_', '-') AS p, trim(lower(coalesce(title, ''))) AS t FROM harvested_urls),
    m AS (SELECT u.id, k.*, regexp_matches(p, '(^|/)' || w || '(-|/|$)') AS leads, contains(t, w) AS said, contains(p, w) AS buried FROM u, k),
    c AS (SELECT id, arg_min(clean - CASE WHEN leads THEN 0 ELSE 5 END, ord) AS s, arg_min(w, ord) AS w FROM m WHERE leads OR said GROUP BY id),
    i AS (SELECT id, arg_min(inner_s, ord) AS s, arg_min(w, ord) AS w FROM m WHERE buried GROUP BY id),
    l AS (SELECT u.id, arg_min(lo.w, lo.ord) AS w FROM u, lo WHERE contains(p, lo.w) OR contains(t, lo.w) GROUP BY u.id)
    SELECT u.id, CAST(CASE WHEN c.id IS NOT NULL THEN c.s WHEN i.id IS NOT NULL THEN i.s WHEN l.id IS NOT NULL THEN 0 ELSE 10 END AS INTEGER) AS score,
           coalesce(c.w, i.w, l.w, '') AS matched
    FROM u LEFT JOIN c USING (id) LEFT JOIN i USING (id) LEFT JOIN l USING (id)"""

_HUMAN = """CASE WHEN contains(r, 'robots') THEN 'The site''s robots.txt asks crawlers not to fetch this page.'
    WHEN c = 401 OR contains(r, 'login') OR contains(r, 'auth') THEN 'This page requires signing in, so its content is not public.'
    WHEN c = 403 OR contains(r, 'denied') OR contains(r, 'forbidden') THEN 'The website denied automated access to this page.'
    WHEN c = 429 OR contains(r, 'rate') THEN 'The website rate-limited the crawler. Try again later.'
    WHEN c = 404 OR contains(r, 'not found') THEN 'The page does not exist at this address.'
    WHEN c = 408 OR contains(r, 'timeout') THEN 'The page took too long to respond.'
    WHEN c >= 500 THEN 'The website returned a server error.'
    WHEN contains(r, 'bot protection') OR contains(r, 'captcha') THEN 'The website showed a bot-protection challenge instead of the page.'
    WHEN contains(r, 'ssl') OR contains(r, 'certificate') THEN 'The site''s security certificate could not be verified.'
    WHEN contains(r, 'dns') OR contains(r, 'name or service') OR contains(r, 'getaddrinfo') THEN 'The domain could not be resolved - it may not exist.'
    WHEN contains(r, 'connection') OR contains(r, 'reset') OR contains(r, 'refused') THEN 'The connection to the website failed.'
    WHEN contains(r, 'no extractable text') OR contains(r, 'insufficient') THEN 'The page loaded but no useful text could be extracted.'
    WHEN contains(r, 'javascript') THEN 'The page needs JavaScript rendering, and no browser was available.'
    WHEN contains(r, 'unsupported content type') OR contains(r, 'document') THEN 'This URL does not point at a readable web page.'
    ELSE 'The page could not be harvested.' END"""


def _any(col: str, words) -> str:
    return " OR ".join("contains({}, '{}')".format(col, w.replace("'", "''")) for w in words)


_MARKERS = " ".join(f"WHEN contains(h, '{m}') THEN 'blocked by {n} (a challenge page was served with HTTP 200)'" for m, n in st.CHALLENGE_MARKERS)
_CHUNK_NORMAL = (
    "regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(list_transform("
    f"string_split(regexp_replace(coalesce(text_content, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda v: {q.strip('v')}), "
    "lambda v: v = '' OR length(v) >= 3), lambda v: regexp_replace(v, '[ \\t]+', ' ', 'g')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), "
    f"'^{q.WS}+|{q.WS}+$', '', 'g')"
)


def _text_of(pattern: str) -> str:
    x = f"regexp_extract(raw_html, '(?is){pattern}', 1)"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", chr(34)), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim({x})"


def _fetches(s, d):
    """Stored pages after their latest fetch, a fetch with an id as its attempt order."""
    f = table(s, d, "fetch_results").filter("fetched_at is not null")
    return harvest.store_results(_h(s, d), f.withColumn("fetched_at", F.struct("fetched_at", "fetch_id")), F.lit(None).cast("timestamp"))


def queries():
    return {
        # URL functions and uploads
        "url_normalize": lambda s, d: _h(s, d).select("id", urls.normalize_url(F.col("url")).alias("normalized"), urls.domain_of(F.col("url")).alias("url_domain")),
        "url_domain_counts": lambda s, d: _h(s, d).groupBy(urls.domain_of(F.col("normalized_url")).alias("site")).agg(F.count(F.lit(1)).alias("n_pages")),
        "url_same_domain": lambda s, d: _h(s, d).select("id", F.coalesce(urls.same_domain(F.col("url"), F.col("final_url")), F.lit(False)).alias("same_site")),
        "upload_rows": lambda s, d: _sheet(s, d).select("row_id", "bucket", "reason", "candidate", "normalized_url"),
        "upload_buckets": lambda s, d: upload.bucket_counts(_sheet(s, d), ["batch_id"]),
        "upload_reasons": lambda s, d: upload.reason_counts(_sheet(s, d), ["batch_id"]),
        "url_guard": lambda s, d: table(s, d, "sheet_rows").select("row_id", guard.reject_reason(F.col("url")).alias("reason")),
        "link_score": lambda s, d: _h(s, d).select("id", links.link_score(F.col("url"), F.col("title")).alias("x")).select("id", "x.score", "x.matched"),
        "document_kind": lambda s, d: _h(s, d).select("id", F.coalesce(detect_kind(F.col("content_type"), F.col("url")), F.lit("")).alias("kind")),
        "unseen_parents": lambda s, d: _h(s, d).filter("parent_url <> ''").select(urls.dedup_key(F.col("parent_url")).alias("key")).distinct().join(_h(s, d).select(F.col("normalized_url").alias("key")).distinct(), "key", "left_anti"),
        "page_links": lambda s, d: crawl.page_links(_h(s, d)).select("page_id", "url", "score", "matched", "rank"),
        # texts and quality
        "doc_quality_gate": lambda s, d: table(s, d, "documents").select("doc_id", quality.assess(F.col("text")).alias("x")).select("doc_id", "x.ok", "x.reason", "x.char_count", "x.word_count", "x.line_count"),
        "page_quality": lambda s, d: _h(s, d).select("id", quality.assess(F.col("text_content")).alias("x")).select("id", "x.ok", "x.reason", "x.char_count", "x.word_count", "x.line_count"),
        "content_hash_dups": lambda s, d: table(s, d, "documents").filter("text <> ''").groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 1"),
        "text_squash": lambda s, d: _h(s, d).select("id", F.sha2(text.squash(F.col("text_content")), 256).alias("squashed")),
        "title_shorten": lambda s, d: _h(s, d).select("id", text.shorten(F.col("title"), 40).alias("short_title")),
        "prompt_truncation": lambda s, d: table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2(text.truncate_for_prompt(F.col("text")), 256).alias("prompt_hash"), F.length(text.truncate_for_prompt(F.col("text"))).alias("prompt_chars")),
        "chunk_normal": lambda s, d: _h(s, d).select("id", F.sha2(text.chunk_normal(F.col("text_content")), 256).alias("normal")),
        "chunk_text": lambda s, d: index.make_chunks(_h(s, d)).select("url_id", "ordinal", "char_start", "char_end", "heading", F.length("text").alias("chars")),
        "html_pages": lambda s, d: _h(s, d).filter("raw_html <> ''").select("id", html.page_extractor()(F.col("raw_html")).alias("p")).select("id", "p.title", "p.description", "p.method", F.length("p.text").alias("chars"), F.coalesce(F.try_element_at("p.meta", F.lit("lang")), F.lit("")).alias("lang")),
        "html_meta": lambda s, d: _h(s, d).filter("raw_html <> ''").select("id", html.page_extractor()(F.col("raw_html")).alias("p")).select("id", "p.title", "p.description", F.coalesce(F.try_element_at("p.meta", F.lit("lang")), F.lit("")).alias("lang")),
        "page_anchors": lambda s, d: _h(s, d).filter("raw_html <> ''").select("id", F.size(html.anchors(F.col("raw_html"), F.col("url"))).alias("n_links")),
        "reextract": lambda s, d: harvest.reextract(_h(s, d)).select("id", "crawl_status", "char_count", "word_count", "content_hash"),
        # classification
        "block_reason": lambda s, d: table(s, d, "fetch_results").select("fetch_id", st.block_reason(F.col("text"), F.col("title"), F.col("html")).alias("reason")),
        "humanise_failure": lambda s, d: _h(s, d).select("id", st.failure_line(F.col("error"), F.col("http_status")).alias("sentence")),
        "status_labels": lambda s, d: _h(s, d).select("crawl_status", "http_status").distinct().select("crawl_status", "http_status", st.status_label(F.col("crawl_status")).alias("label"), st.status_badge(F.col("crawl_status")).alias("badge"), st.http_phrase(F.col("http_status")).alias("phrase")),
        "status_from_http": lambda s, d: table(s, d, "fetch_results").select("fetch_id", st.status_from_http(F.col("status_code")).alias("outcome")),
        "backfill": lambda s, d: harvest.backfill(_h(s, d)).select("id", "crawl_status", "char_count", "domain"),
        "usable_pages": lambda s, d: _h(s, d).groupBy(st.is_usable(F.col("crawl_status"), F.col("text_content")).alias("usable")).agg(F.count(F.lit(1)).alias("n_pages")),
        "incremental_targets": lambda s, d: index.targets(_h(s, d)).select("id"),
        "leadership_pages": lambda s, d: _h(s, d).select("id", people.is_leadership_page(F.col("text_content"), F.col("url")).alias("leads")),
        "store_results": lambda s, d: _fetches(s, d).select("id", "http_status", "crawl_status", "content_hash", "domain", "error"),
    }


def oracle_sql():
    latest = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY fetched_at DESC, fetch_id DESC) AS rn FROM fetch_results WHERE fetched_at IS NOT NULL) WHERE rn = 1"
    return {
        "url_normalize": f"SELECT id, {q.dedup_key('trim(url)')} AS normalized, {q.domain('url')} AS url_domain FROM harvested_urls",
        "url_domain_counts": f"SELECT {q.domain('normalized_url')} AS site, count(*) AS n_pages FROM harvested_urls GROUP BY 1",
        "url_same_domain": f"SELECT id, coalesce({q.domain('url')} <> '' AND {q.domain('url')} = {q.domain('final_url')}, false) AS same_site FROM harvested_urls",
        "upload_rows": _CLASSIFIED + " SELECT row_id, bucket, reason, cand AS candidate, norm AS normalized_url FROM b",
        "upload_buckets": _CLASSIFIED
        + """, n5 AS (SELECT batch_id, count(*) FILTER (bucket = 'valid') AS valid, count(*) FILTER (bucket = 'blank') AS blank, count(*) FILTER (bucket = 'invalid') AS invalid,
               count(*) FILTER (bucket = 'duplicate') AS duplicate, count(*) FILTER (bucket = 'rejected') AS rejected, count(*) AS total FROM b GROUP BY batch_id)
             SELECT *, total || ' row(s): ' || valid || ' valid' || CASE WHEN duplicate > 0 THEN ', ' || duplicate || ' duplicate' ELSE '' END || CASE WHEN invalid > 0 THEN ', ' || invalid || ' invalid' ELSE '' END
               || CASE WHEN blank > 0 THEN ', ' || blank || ' empty' ELSE '' END || CASE WHEN rejected > 0 THEN ', ' || rejected || ' refused' ELSE '' END AS summary FROM n5""",
        "upload_reasons": _CLASSIFIED + " SELECT batch_id, reason, count(*) AS n_rows FROM b WHERE reason <> '' GROUP BY 1, 2",
        "url_guard": f"""WITH u AS (SELECT row_id, trim(coalesce(url, '')) AS u, {q.host("trim(coalesce(url, ''))")} AS h, lower(regexp_extract(trim(coalesce(url, '')), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s FROM sheet_rows)
            SELECT row_id, CASE WHEN u = '' THEN 'empty URL' WHEN s NOT IN ('http', 'https') THEN 'unsupported scheme ' || chr(39) || CASE WHEN s = '' THEN 'none' ELSE s END || chr(39) || ' - only http and https'
            WHEN h = '' THEN 'no host in URL' ELSE '' END AS reason FROM u""",
        "status_labels": "WITH l(k, label, badge) AS (VALUES " + ", ".join(f"('{k}', '{v}', 'badge {st.BADGES[k]}')" for k, v in st.LABELS.items()) + "), p(c, phrase) AS (VALUES " + ", ".join("({}, '{}')".format(int(x), x.phrase.replace("'", "''")) for x in HTTPStatus) + ") SELECT DISTINCT crawl_status, http_status, coalesce(label, crawl_status, '') AS label, coalesce(badge, 'badge badge-muted') AS badge, coalesce(phrase, '') AS phrase FROM harvested_urls LEFT JOIN l ON k = upper(crawl_status) LEFT JOIN p ON c = http_status",
        "link_score": _LINKS,
        "document_kind": "SELECT id, CASE lower(trim(split_part(coalesce(content_type, ''), ';', 1))) WHEN 'application/pdf' THEN 'pdf' WHEN 'text/plain' THEN 'text' ELSE CASE WHEN regexp_matches(lower(url), '\\.pdf([?#]|$)') THEN 'pdf' ELSE '' END END AS kind FROM harvested_urls",
        "unseen_parents": f"SELECT DISTINCT {q.dedup_key('parent_url')} AS key FROM harvested_urls WHERE parent_url <> '' AND {q.dedup_key('parent_url')} NOT IN (SELECT normalized_url FROM harvested_urls WHERE normalized_url IS NOT NULL)",
        "doc_quality_gate": q.quality("documents", "doc_id", "text"),
        "page_quality": q.quality("harvested_urls", "id", "text_content"),
        "content_hash_dups": "SELECT sha256(text) AS content_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1",
        "text_squash": f"SELECT id, sha256(lower(regexp_replace(regexp_replace(coalesce(text_content, ''), '{q.WS}+', ' ', 'g'), '^{q.WS}+|{q.WS}+$', '', 'g'))) AS squashed FROM harvested_urls",
        "title_shorten": "SELECT id, CASE WHEN length(coalesce(title, '')) > 40 THEN substring(title, 1, 39) || '…' ELSE coalesce(title, '') END AS short_title FROM harvested_urls",
        "prompt_truncation": "SELECT doc_id, sha256(p) AS prompt_hash, CAST(length(p) AS INTEGER) AS prompt_chars FROM (SELECT doc_id, CASE WHEN length(text) > 8000 THEN substring(text, 1, 6000) || chr(10) || chr(10) || '[...middle of page omitted...]' || chr(10) || chr(10) || substring(text, length(text) - 1999, 2000) ELSE text END AS p FROM documents WHERE text IS NOT NULL)",
        "chunk_normal": f"SELECT id, sha256({_CHUNK_NORMAL}) AS normal FROM harvested_urls",
        "html_meta": f"SELECT id, {_text_of('<title[^>]*>([^<]*)</title>')} AS title, {_text_of('<meta name=.description. content=.([^>]*).>')} AS description, regexp_extract(raw_html, '(?i)<html[^>]*\\slang=.([a-zA-Z-]+)', 1) AS lang FROM harvested_urls WHERE raw_html <> ''",
        "page_anchors": "SELECT id, CAST(len(regexp_extract_all(raw_html, '(?i)<a\\s[^>]*href=[^>]*>')) AS INTEGER) AS n_links FROM harvested_urls WHERE raw_html <> ''",
        "block_reason": f"SELECT fetch_id, CASE {_MARKERS} WHEN length(t) <= 2500 AND ({_any('t', st.CHALLENGE_PHRASES)}) THEN 'blocked by site bot protection (a challenge page was served with HTTP 200)' ELSE '' END AS reason FROM (SELECT fetch_id, lower(coalesce(html, '')) AS h, lower(regexp_replace(regexp_replace(coalesce(title, '') || chr(10) || coalesce(text, ''), '{q.WS}+', ' ', 'g'), '^ +| +$', '', 'g')) AS t FROM fetch_results)",
        "humanise_failure": f"SELECT id, CASE WHEN coalesce(error, '') = '' THEN '' ELSE {_HUMAN} END AS sentence FROM (SELECT id, error, lower(coalesce(error, '')) AS r, coalesce(http_status, 0) AS c FROM harvested_urls)",
        "status_from_http": "SELECT fetch_id, CASE WHEN status_code IS NULL THEN 'FAILED' WHEN status_code IN (401, 403, 429, 451) THEN 'BLOCKED' WHEN status_code >= 400 THEN 'FAILED' ELSE 'SUCCESS' END AS outcome FROM fetch_results",
        "backfill": f"""SELECT id, CASE WHEN fetched_at IS NULL THEN crawl_status WHEN text_content <> '' AND coalesce(error, '') = '' THEN 'SUCCESS' WHEN text_content <> '' THEN 'PARTIAL'
            WHEN http_status IN (401, 403, 429, 451) THEN 'BLOCKED' WHEN error ILIKE '%bot protection%' THEN 'BLOCKED' WHEN error ILIKE '%robots.txt%' THEN 'SKIPPED'
            WHEN http_status IS NULL AND coalesce(error, '') = '' THEN 'PENDING' WHEN http_status IS NULL THEN 'FAILED' WHEN http_status < 400 THEN 'PARTIAL' ELSE 'FAILED' END AS crawl_status,
            CAST(CASE WHEN coalesce(char_count, 0) = 0 THEN coalesce(length(text_content), 0) ELSE char_count END AS INTEGER) AS char_count,
            CASE WHEN coalesce(domain, '') = '' THEN {q.domain('url')} ELSE domain END AS domain FROM harvested_urls""",
        "usable_pages": "SELECT coalesce(crawl_status IN ('SUCCESS', 'PARTIAL'), false) AND coalesce(text_content, '') <> '' AS usable, count(*) AS n_pages FROM harvested_urls GROUP BY 1",
        "incremental_targets": """SELECT id FROM harvested_urls WHERE (coalesce(text_content, '') <> '' OR coalesce(chunk_count, 0) > 0) AND
            CASE WHEN coalesce(text_content, '') = '' THEN coalesce(chunk_count, 0) > 0 ELSE coalesce(chunk_count, 0) = 0 OR coalesce(indexed_hash, '') <> coalesce(content_hash, '') END""",
        "leadership_pages": "SELECT id, regexp_matches(lower(coalesce(url, '')) || ' ' || lower(array_to_string(list_filter(list_transform(list_slice(string_split(coalesce(text_content, ''), chr(10)), 1, 60), lambda v: trim(v)), lambda v: starts_with(v, '#')), ' ')), '\\b(?:" + "|".join(people.PEOPLE_PAGES) + ")\\b') AS leads FROM harvested_urls",
        "store_results": f"""WITH f AS ({latest.format(k=q.dedup_key('trim(url)'))})
            SELECT h.id, CASE WHEN f.url IS NULL THEN h.http_status ELSE f.status_code END AS http_status, CASE WHEN f.url IS NULL THEN h.crawl_status ELSE f.crawl_status END AS crawl_status,
            CASE WHEN f.url IS NULL THEN h.content_hash WHEN coalesce(f.text, '') = '' THEN '' ELSE sha256(f.text) END AS content_hash,
            CASE WHEN f.url IS NULL THEN h.domain ELSE {q.domain("coalesce(nullif(f.final_url, ''), h.url)")} END AS domain,
            CASE WHEN f.url IS NULL THEN h.error ELSE coalesce(f.error, '') END AS error
            FROM harvested_urls h LEFT JOIN f ON h.normalized_url = {q.dedup_key('trim(f.url)')}""",
    }
