"""Operators on small literal tables, against brute force where there is one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.operators import answers, crawl, graph, harvest, index, listing, log, records, search, upload
from lodestack.settings import Settings


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_upload_buckets(spark):
    rows = [(1, 1, "https://a.example/x"), (2, 1, "not-a-url"), (3, 1, ""), (4, 1, "https://A.example/x/#f"), (5, 1, None), (6, 1, "www.b.example/t"), (7, 1, "http://localhost/"), (8, 2, "https://a.example/x"), (9, None, "https://a.example/x"), (10, None, "https://a.example/x")]
    c = upload.classify_rows(spark.createDataFrame(rows, "row_id long, batch_id long, url string"), "url", "row_id", ["batch_id"])
    got = {r.row_id: r.bucket for r in c.collect()}
    assert got == {1: "valid", 2: "invalid", 3: "blank", 4: "duplicate", 5: "blank", 6: "valid", 7: "rejected", 8: "valid", 9: "valid", 10: "duplicate"}
    n = upload.bucket_counts(c, ["batch_id"]).filter("batch_id = 1").first()
    assert (n.valid, n.blank, n.invalid, n.duplicate, n.rejected, n.total) == (2, 2, 1, 1, 1, 7)
    assert n.summary == "7 row(s): 2 valid, 1 duplicate, 1 invalid, 2 empty, 1 refused"
    m = upload.rejected_map(c, ["batch_id"]).filter("batch_id = 1").first().rejected_json
    assert m["empty value"] == 2 and m[upload.DUPLICATE] == 1
    p = upload.pending_rows(c.filter("batch_id = 1"), 5).orderBy("url").collect()
    assert [r.url for r in p] == ["https://a.example/x", "https://www.b.example/t"] and '"row_id":"1"' in p[0].meta_json["row"]
    with pytest.raises(ValueError):
        upload.check_upload(10**9, 1)
    with pytest.raises(ValueError):
        upload.check_upload(1, 10**6)


GOOD = "<html><title>T</title><body>" + "".join(f"<p>Sentence number {i} tells of many things in the town.</p>" for i in range(40)) + "</body></html>"
RAW = "url string, status_code int, final_url string, content_type string, body binary, error string, attempts int, elapsed_ms int"


def test_outcomes(spark):
    rows = [
        ("u1", 200, "u1", "text/html", GOOD.encode(), "", 1, 1),
        ("u2", 200, "u2", "text/html", b"<p>thin</p>", "", 1, 1),
        ("u3", 403, "u3", "text/html", b"", "", 1, 1),
        ("u4", 500, "u4", "text/html", b"", "", 3, 1),
        ("u5", None, "u5", "", None, "timeout", 3, 1),
        ("u6", None, "u6", "", None, "no host in URL", 0, 0),
        ("u7", 200, "u7", "text/html", b"<title>Your request has been blocked</title><p>go away</p>", "", 1, 1),
        ("u8", 200, "u8", "image/png", b"x", "", 1, 1),
        ("u9", 200, "u9", "text/plain; charset=utf-8", b"plain  words", "", 1, 1),
        ("u10", 200, "u10.docx", "", b"broken", "", 1, 1),
    ]
    got = {r.url: r for r in harvest.extract_pages(spark.createDataFrame(rows, RAW)).collect()}
    assert {u: r.crawl_status for u, r in got.items()} == {"u1": "SUCCESS", "u2": "PARTIAL", "u3": "BLOCKED", "u4": "FAILED", "u5": "FAILED", "u6": "SKIPPED", "u7": "BLOCKED", "u8": "FAILED", "u9": "SUCCESS", "u10": "FAILED"}
    assert got["u7"].text == "" and got["u7"].meta["blocked_snippet"] == "go away"
    assert got["u9"].text == "plain words" and got["u9"].scraping_method == "document"
    assert "could not open .docx" in got["u10"].error and got["u8"].error.startswith("unsupported content type")


def pages(spark, rows):
    cols = "id long, batch_id long, url string, normalized_url string, text_content string, raw_html string, content_hash string, indexed_hash string, chunk_count int, title string, crawl_status string, error string, fetched_at timestamp"
    return schemas.sync_columns(spark.createDataFrame(rows, cols), "harvested_urls")


def page(i, text, batch=1, h="h", ih="", n=0, html="", title="t"):
    return (i, batch, f"https://s.example/{i}", f"https://s.example/{i}", text, html, h, ih, n, title, "SUCCESS", "", None)


def test_store_results_merges_latest(spark):
    p = pages(spark, [page(1, "old"), page(2, "keep")]).withColumn("meta_json", F.create_map(F.lit("row"), F.lit("r"), F.lit("canonical"), F.lit("c0")))
    f = spark.createDataFrame(
        [("https://s.example/1/", 200, "https://www.s.example/1", "text/html", "<p>", "new", "T", "", {"canonical": "c1"}, "", 5, "SUCCESS", "dom", 1, 3, 2), ("https://S.example/1", 500, "", "", "", "", "", "", None, "HTTP 500", 5, "FAILED", "", 0, 0, 1)],
        "url string, status_code int, final_url string, content_type string, html string, text string, title string, description string, meta map<string,string>, error string, elapsed_ms int, crawl_status string, scraping_method string, word_count int, char_count int, attempts int",
    )
    got = {r.id: r for r in harvest.store_results(p, f).collect()}
    assert (got[1].text_content, got[1].domain, got[1].canonical_url, got[1].meta_json["row"], got[1].http_status) == ("new", "s.example", "c1", "r", 200)
    assert got[2].text_content == "keep" and got[2].meta_json["canonical"] == "c0"


def test_incremental_index(spark, tmp_path):
    text = "Alpha beta gamma delta. " * 100
    p = pages(spark, [page(1, text, h="a"), page(2, "", n=3), page(3, "short text here", h="b", ih="b", n=1), page(4, None), page(5, "changed text here", h="c", ih="x", n=1, batch=2)])
    assert {r.id for r in index.targets(p).collect()} == {1, 2, 5}
    assert {r.id for r in index.targets(p, batch_id=2).collect()} == {5} and {r.id for r in index.targets(p, rebuild=True).collect()} == {1, 2, 3, 5}
    old = index.make_chunks(pages(spark, [page(3, "short text here"), page(2, "gone text"), page(5, "stale text")]))
    np_, nc, nv = index.reindex(p, old, index.make_vectors(old))
    assert {r.url_id for r in nc.collect()} == {1, 3, 5} and index.integrity(nc, nv).count() == 0
    state = {r.id: (r.chunk_count, r.indexed_hash) for r in np_.collect()}
    assert state[2][0] == 0 and state[1][0] > 1 and state[1][1] == "a"
    assert index.targets(np_).count() == 0  # a second pass is a no-op
    meta = index.save_snapshot(nv, str(tmp_path / "ix")).first()
    assert meta.vector_count == nv.count() and index.load_snapshot(spark, str(tmp_path / "ix")).count() == nv.count()
    assert index.load_snapshot(spark, str(tmp_path / "none")).count() == 0
    assert index.describe(nv, "v", "p").first().dim == 384


def test_exact_topk_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    m[10] = m[20] = m[30]
    v = spark.createDataFrame([(i, m[i].tolist()) for i in range(300)] + [(999, None)], "chunk_id long, embedding array<double>").repartition(5)
    qs = spark.createDataFrame([(i, q[i].tolist()) for i in range(7)], "query_id long, embedding array<double>")
    want = {(i, int(c), r + 1) for i in range(7) for r, c in enumerate(sorted(range(300), key=lambda c: (-float(q[i] @ m[c]), c))[:5])}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in search.exact_topk(v, qs, 5).collect()} == want
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in search.exact_topk(v, qs, 5).collect()} == want
    assert search.exact_topk(v, qs.limit(0), 5).count() == 0


@pytest.mark.parametrize("scores,want", [((0.54, 0.26), {1}), ((0.50, 0.45), {1, 2}), ((0.10,), set()), ((0.30, 0.28), {1, 2})])
def test_relevance_gate(spark, scores, want):
    df = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "query_id long, url_id long, score double")
    assert {r.url_id for r in search.relevance_gate(df).filter("relevant").collect()} == want


def test_threshold_or_best(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.1, 2), (2, 0.2, 1), (2, 0.1, 2)], "query_id long, score double, rank int")
    got = {(r.query_id, r["rank"], r.low_confidence) for r in search.threshold_or_best(df, Settings(), 1).collect()}
    assert got == {(1, 1, False), (2, 1, True)}


def corpus(spark):
    a, b = "Acme rockets are led by Jane Smith, Chief Executive Officer of Acme rockets.", "Globex harbours ships and cranes in the northern harbour of Globex."
    return pages(spark, [page(1, a, title="Acme"), page(2, b, title=""), page(3, a, batch=2, title="Acme again")]).withColumn("normalized_url", F.when(F.col("id") == 3, "https://s.example/1").otherwise(F.col("normalized_url")))


def test_search_end_to_end(spark):
    p = corpus(spark)
    c = index.make_chunks(p)
    people = spark.createDataFrame([(1, 1, "Jane Smith", "Chief Executive Officer", "Acme", 0.9), (2, 1, "Bob Low", "CFO", "Acme", None), (4, 3, "Jane Smith", "Chief Executive Officer", "Acme", 0.9), (5, 3, "Bob Low", "CFO", "Acme", None), (3, 2, "Ann Sea", "Captain", "Globex", 0.5)], "id long, url_id long, name string, title string, company string, confidence double")
    q = spark.createDataFrame([(1, "who leads Acme rockets"), (2, "  "), (3, None)], "query_id long, query string")
    r = search.search(q, c, index.make_vectors(c), p, people)
    rows = r.filter("query_id = 1").orderBy("page_rank").collect()
    assert rows[0].page_key == "https://s.example/1" and [x.page_key for x in rows].count("https://s.example/1") == 1
    assert {x.note for x in r.filter("query_id <> 1").collect()} == {"empty query"}
    assert [x.name for x in rows[0].people] == ["Jane Smith", "Bob Low"] and (len(rows) == 1 or rows[1].people == [])
    cards = search.rank_people(r.filter("query_id = 1").withColumn("answer", F.lit("It is BOB  Low."))).orderBy("rank").collect()
    assert [x.name for x in cards] == ["Bob Low", "Jane Smith"] and cards[0].named
    slots = answers.context_slots(r)
    ctx = answers.build_context(slots).first().context
    assert ctx.startswith("[1] Acme\nURL: https://s.example/1\nAcme rockets")
    out = answers.answer(r, q, lambda sys, user: "Jane leads [1].").filter("query_id = 1")
    src = answers.cited_sources(out, slots).collect()
    assert [(x.source_rank, x.cited, x.url) for x in src] == [(1, 1, "https://s.example/1")]
    assert "unavailable" in answers.answer(r, q).filter("query_id = 1").first().note
    assert search.search(q, c, index.make_vectors(c).limit(0), p).filter("query_id = 1").first().note == "nothing indexed matches"
    assert log.log_rows(q, r, 8).filter("id = 1").first().result_count == len(rows)


def test_fallback_completer():
    def bad(s, u):
        raise RuntimeError("down")

    assert answers.FallbackCompleter(bad, lambda s, u: "ok")("", "") == "ok"
    with pytest.raises(answers.CompletionUnavailable):
        answers.FallbackCompleter(bad)("", "")


def test_context_order_is_bounded_and_numbered(spark):
    rows = [(1, r, f"t{r}", f"u{r}", [(c, 0.5, (None, f"x{r}{c}")) for c in range(3)]) for r in (2, 1, 3)]
    df = spark.createDataFrame(rows, "query_id long, page_rank int, title string, url string, matched_chunks array<struct<chunk_id:long,score:double,payload:struct<heading:string,text:string>>>")
    s = answers.context_slots(df)
    assert [(x.slot, x.url) for x in s.orderBy("slot").collect()] == [(i + 1, f"u{i // 3 + 1}") for i in range(9)]
    assert answers.build_context(s).first().context.count("URL:") == 6
    a = spark.createDataFrame([(1, "see [7] and 【1†L9-L11】, [1], [99]")], "query_id long, answer string")
    assert [(x.cited, x.url) for x in answers.cited_sources(a, s).orderBy("source_rank").collect()] == [(7, "u3"), (1, "u1")]


def test_merge_records(spark):
    m = records.coerce(spark.createDataFrame([(1, 0, "Jane Smith", "", "Acme", "0.7"), (1, 1, "jane smith", "CEO", "", "x"), (1, 2, "", "x", "", "1"), (1, 3, "Ann", None, None, None)], "url_id long, pos long, name string, title string, company string, confidence string"))
    p = records.coerce(spark.createDataFrame([(1, 0, "ANN", "CFO", 0.8, "ev"), (1, 1, "Bob", "CTO", 0.6, "ev2"), (2, 0, "Cy", "X", 2.0, "e")], "url_id long, pos long, name string, title string, confidence double, evidence string"))
    got = [(r.url_id, r["rank"], r.name, r.title, r.confidence, r.pattern_evidence) for r in records.merge_records(m, p).orderBy("url_id", "rank").collect()]
    assert got == [(1, 1, "jane smith", "CEO", None, ""), (1, 2, "Ann", "CFO", 0.8, "ev"), (1, 3, "Bob", "CTO", 0.6, ""), (2, 1, "Cy", "X", 1.0, "")]


def test_replies_and_chunk_links(spark):
    df = spark.createDataFrame([(1, 'Here: {"people": [{"name": " Jane ", "confidence": 3}, {"title": "x"}]} bye'), (2, "none"), (3, None)], "url_id long, reply string")
    got = records.records_from_replies(df).orderBy("pos").collect()
    assert [(r.url_id, r.name, r.confidence) for r in got] == [(1, "Jane", 1.0), (1, "", None)]
    c = spark.createDataFrame([(1, 10, "hello JANE"), (1, 11, "jane x"), (2, 12, "jane")], "url_id long, chunk_id long, text string")
    linked = {r.name: r.source_chunk_ids for r in records.link_chunks(got_df(spark), c).collect()}
    assert linked == {"Jane": [10, 11], "Bob": [], "": []}
    stored = spark.createDataFrame([(1, "old"), (2, "keep")], "url_id long, name string")
    new = spark.createDataFrame([(1, "new")], "url_id long, name string")
    assert {(r.url_id, r.name) for r in records.replace_for_pages(stored, new, new).collect()} == {(1, "new"), (2, "keep")}


def got_df(spark):
    return spark.createDataFrame([(1, "Jane"), (1, "Bob"), (1, "")], "url_id long, name string")


def test_pages_to_extract(spark):
    p = pages(spark, [page(1, "a"), page(2, "b"), page(3, ""), page(4, "d")]).withColumn("person_count", F.when(F.col("id") == 1, 2).otherwise(0)).withColumn("meta_json", F.create_map(F.lit("people_extracted"), F.lit("1")))
    assert {r.id for r in records.pages_to_extract(p).collect()} == {2, 4} and records.pages_to_extract(p, True).count() == 3


def test_links_and_bfs(spark):
    site = {1: '<a href="/team">Team</a><a href="/team/#x">again</a><a href="mailto:x">m</a><a href="https://o.example/">o</a><a href="/a.pdf">p</a><a href="/1">self</a><a href="/news">n</a>'}
    p = spark.createDataFrame([(1, "https://s.example/1", site[1]), (2, "https://s.example/2", None)], "id long, url string, raw_html string")
    got = [(r.url, r.score, r["rank"]) for r in crawl.page_links(p).orderBy("rank").collect()]
    assert got == [("https://s.example/team", 90, 1), ("https://s.example/news", 0, 2)]
    web = {"https://s.example/team": '<a href="/people/jane">Jane</a><a href="/1">back</a>', "https://s.example/people/jane": '<a href="/deep">d</a>'}

    def fetch(level):
        return level.select(F.xxhash64("url").alias("id"), "url", F.coalesce(*[F.when(F.col("url") == u, h) for u, h in web.items()]).alias("raw_html"))

    found = {(r.depth, r.url) for r in crawl.discover(p, fetch, Settings(max_crawl_depth=2)).collect()}
    assert found == {(1, "https://s.example/team"), (1, "https://s.example/news"), (2, "https://s.example/people/jane")}
    assert crawl.discover(p.filter("id = 2"), fetch).count() == 0


def test_listing(spark):
    p = pages(spark, [page(i, "x" * i, title="News 100%" if i == 2 else "t") for i in range(1, 6)])
    assert [r.id for r in listing.page_listing(p, "-id", 2, 2).collect()] == [3, 2]
    assert [r.id for r in listing.page_listing(p, "bogus", 1, 9999, q="news").collect()] == [2]
    r = listing.page_listing(p, "id", 1, 1).first()
    assert r.text_length == 1 and "text_content" not in r.asDict() and "text_content" in listing.page_listing(p, include_content=True).columns
    assert tuple(listing.page_count(p, 2).first()) == (5, 3) and tuple(listing.page_count(p, 2, batch=9).first()) == (0, 0)
    c = listing.crawl_counts(p.withColumn("crawl_status", F.when(F.col("id") == 1, None).when(F.col("id") == 2, "SKIPPED").otherwise("SUCCESS"))).first()
    assert (c.total, c.success, c.pending) == (5, 3, 1)


def test_jobs(spark):
    j = spark.createDataFrame([(1, "running", 10, 5), (2, "success", 0, 0), (3, "queued", 0, 0), (4, "failed", 3, 9), (5, "success", None, None)], "id long, status string, total int, processed int").withColumn("message", F.lit("")).withColumn("succeeded", F.lit(0)).withColumn("failed", F.lit(0))
    assert {r.id: r.percent for r in listing.job_listing(j).collect()} == {1: 50, 2: 100, 3: 0, 4: 100, 5: 100}
    assert {r.id for r in listing.fail_orphans(j).filter("status = 'failed'").collect()} == {1, 3, 4}
    o = spark.createDataFrame([(1, True), (1, False)], "job_id long, ok boolean")
    r = listing.finish_job(j, o).filter("id = 1").first()
    assert (r.processed, r.succeeded, r.failed, r.status) == (2, 1, 1, "success")


def test_schema_upgrade_and_keys(spark):
    old = spark.createDataFrame([(1, "u", "extra")], "id long, url string, odd string")
    new = schemas.sync_columns(old, "harvested_urls")
    r = new.first()
    assert r.text_content == "" and r.char_count == 0 and r.fetched_at is None and new.columns[-1] == "odd"
    d = spark.createDataFrame([(2, 1, 0, "b"), (1, 1, 0, "a"), (3, 1, 1, "c")], "id long, url_id long, ordinal int, text string")
    assert schemas.key_violations(d, "chunks").count() == 1
    assert {(r.id, r.text) for r in schemas.deduplicate(d, "chunks").collect()} == {(1, "a"), (3, "c")}
    assert schemas.empty(spark, "vectors").count() == 0


def test_reextract(spark):
    p = pages(spark, [page(1, "old", html=GOOD), page(2, "stay", html=""), page(3, "old", html="<p>thin</p>")])
    got = {r.id: r for r in harvest.reextract(p).collect()}
    assert got[1].crawl_status == "SUCCESS" and got[1].text_content.startswith("Sentence number 0") and got[1].word_count > 100
    assert got[2].text_content == "stay" and got[3].crawl_status == "PARTIAL" and "insufficient" in got[3].error


def test_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "q", "2024-01-01"), (1, "q2", "2024-01-02"), (2, None, None)], "id long, query string, created_at string")
    assert {(r.id, r.query) for r in log.deduplicated(df).collect()} == {(1, "q2"), (2, None)}
    assert log.append(df, str(tmp_path / "log")) and spark.read.parquet(str(tmp_path / "log")).count() == 3
    (tmp_path / "file").write_text("x")
    assert not log.append(df, str(tmp_path / "file" / "sub"))


def test_page_company_reads_the_top_of_the_page(spark, tmp_path):
    from lodestack.plans import table_queries

    rows = [(1, "Klajeve Instruments | Leadership\nx", "https://www.foo.example/a"), (2, "Our team: Zosulo Mining", "https://foo.example/b"), (3, "About Fenkive Ceramics\nx", "https://foo.example/c"), (4, "Plain text", "https://foo.example/d"), (5, None, "https://bar.example/")]
    spark.createDataFrame(rows, "id long, text_content string, normalized_url string").write.parquet(f"{tmp_path}/harvested_urls.parquet")
    got = {r.id: r.company for r in table_queries.queries()["page_company"](spark, str(tmp_path)).collect()}
    assert got == {1: "Klajeve Instruments", 2: "Zosulo Mining", 3: "Fenkive Ceramics", 4: "Foo", 5: "Bar"}


def test_topk_in_blocks_equals_brute_force(spark, monkeypatch):
    """More questions than one block meet the vectors by key; ties go to the least id either way."""
    import numpy as np

    from lodestack.operators import search

    rng = np.random.default_rng(5)
    v, q = rng.integers(-2, 3, (300, 4)).astype(float), rng.integers(-2, 3, (40, 4)).astype(float)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(77, None)], "query_id int, embedding array<double>")
    s = q @ v.T
    want = {(i, int(c), float(s[i, c]), r) for i in range(40) for r, c in enumerate(np.lexsort((np.arange(300), -s[i]))[:7], 1)}
    for block in (4096, 9):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(search, "VECTOR_BLOCK", 70)
        assert {tuple(r) for r in search.exact_topk(vectors, queries, 7).collect()} == want
        assert search.exact_topk(vectors, queries.limit(0), 7).count() == 0 and search.exact_topk(vectors.limit(0), queries, 7).count() == 0


@pytest.mark.parametrize("n", [5, 1024, 6000])
def test_topk_holds_one_tile_of_scores(n):
    """However many questions and vectors a block has, its scores are held tile by tile; ties go to the least id across tiles."""
    import tracemalloc

    import numpy as np

    from lodestack.operators import search

    rng = np.random.default_rng(8)
    m, q, own = rng.integers(-2, 3, (n, 4)).astype(float), rng.integers(-2, 3, (3000, 4)).astype(float), rng.permutation(n)
    q[:50] = 0
    tracemalloc.start()
    rows, ids, scores = search.best_of_block(q, own, m, 7, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and len(rows) == 3000 * min(n, 7)
    for i in [0, 49, 50, 2047, 2048, 2999]:
        want = sorted(zip(-(m @ q[i]), own))[:7]
        assert sorted(zip(-scores[rows == i], ids[rows == i])) == want


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    """Few edges are one task's work, more take rounds; both give the least node of each component."""
    import random

    from lodestack.operators import graph

    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(-40, 40), rnd.randrange(-40, 40)) for _ in range(30)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(r) for r in graph.connected_components(df).collect()}
    monkeypatch.setattr(graph, "ONE_TASK", 3)
    assert one == {tuple(r) for r in graph.connected_components(df).collect()} and (160, 100) in one
