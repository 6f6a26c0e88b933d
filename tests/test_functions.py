"""Function-level behaviour on literal inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import chunking, guard, html, links, people, quality, status, text, urls, vectors


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw,want",
    [
        (" HTTPS://Example.COM/Team/ ", "https://example.com/Team"),
        ("https://example.com:443/a?b=1#c", "https://example.com/a?b=1"),
        ("http://example.com:8080", "http://example.com:8080/"),
        ("https://u:p@example.com/x//", "https://example.com/x"),
        ("https://under_score.example/a b|c/", "https://under_score.example/a b|c"),
    ],
)
def test_normalize_url(spark, raw, want):
    got = one(spark, raw, urls.normalize_url)
    assert got == want
    assert one(spark, got, urls.normalize_url) == want


def test_domain_and_scheme_rescue(spark):
    assert one(spark, "https://www.Example.com:80/x", urls.domain_of) == "example.com"
    assert one(spark, None, urls.domain_of) == ""
    assert one(spark, "www.example.com/team", urls.rescue_scheme) == "https://www.example.com/team"
    assert one(spark, "ftp://x.y", urls.rescue_scheme) == "https://ftp://x.y"
    assert one(spark, "not a url", urls.rescue_scheme) == "not a url"


@pytest.mark.parametrize(
    "url,part",
    [
        ("", "empty URL"),
        (None, "empty URL"),
        ("http://x:99999/", "malformed URL"),
        ("http://[::1/", "malformed URL"),
        ("file:///etc/passwd", "unsupported scheme 'file'"),
        ("javascript:alert(1)", "unsupported scheme"),
        ("https://", "no host in URL"),
        ("https://a:b@example.com/", "credentials"),
        ("http://localhost/", "local or private"),
        ("http://printer.local/", "local or private"),
        ("http://127.0.0.1/", "local or private"),
        ("http://169.254.169.254/x", "local or private"),
        ("http://10.1.2.3/", "local or private"),
        ("http://[::1]/", "local or private"),
        ("http://[::ffff:127.0.0.1]/", "local or private"),
        ("https://example.com/", ""),
        ("http://8.8.8.8/", ""),
    ],
)
def test_guard(spark, url, part):
    got = one(spark, url, guard.reject_reason)
    assert (got == "") if part == "" else part in got


def test_leads_inside():
    def resolver(host):
        if host == "gone":
            raise OSError("no address")
        return {"in": ["1.1.1.1", "192.168.0.4"], "out": ["1.1.1.1"], "six": ["fd00::1"]}[host]

    assert [guard.leads_inside(h, resolver) for h in ("in", "out", "six", "gone", "", None)] == [True, False, True, False, False, False]
    assert not guard.leads_inside("in", None)


def test_quality(spark):
    prose = " ".join(["word"] * 150)
    menu = "\n".join(["home about team"] * 60)
    q = lambda t: one(spark, t, quality.assess)
    assert q(None).reason == "no extractable text"
    assert q("short").reason == "insufficient extractable content (5 characters)"
    assert q("x" * 600).reason == "insufficient extractable content (1 words)"
    assert q(menu).reason == "page yielded navigation rather than content"
    assert q(prose).ok and q(prose).word_count == 150
    assert one(spark, prose, lambda c: quality.summary(quality.assess(c))) == "749 chars, 150 words, 1 lines, 150.0 words/line"


def test_blocking(spark):
    df = spark.createDataFrame(
        [
            (1, "Please verify you are human", "", ""),
            (2, "", "Your request has been BLOCKED", ""),
            (3, "", "", "<script>window.gokuProps={}</script>"),
            (4, "captcha " * 500, "", ""),
            (5, None, None, None),
        ],
        "id int, t string, h string, m string",
    )
    got = {r.id: r.b for r in df.select("id", status.block_reason(F.col("t"), F.col("h"), F.col("m")).alias("b")).collect()}
    assert "bot protection" in got[1] and "bot protection" in got[2] and "AWS WAF" in got[3] and got[4] == "" and got[5] == ""


@pytest.mark.parametrize(
    "reason,code,part",
    [
        ("disallowed by robots.txt", None, "robots.txt"),
        ("HTTP 401", 401, "signing in"),
        ("HTTP 403", 403, "denied"),
        ("HTTP 429", 429, "rate-limited"),
        ("HTTP 404", 404, "does not exist"),
        ("timeout", None, "too long"),
        ("HTTP 503", 503, "server error"),
        ("ssl error", None, "certificate"),
        ("dns failure", None, "resolved"),
        ("whatever", None, "could not be harvested"),
        ("", None, "could not be harvested"),
    ],
)
def test_humanise(spark, reason, code, part):
    df = spark.createDataFrame([(reason, code)], "r string, c int")
    assert part in df.select(status.humanise_failure(F.col("r"), F.col("c")).alias("x")).first().x


def test_backfill_rules(spark):
    rows = [(200, "text", "", "SUCCESS"), (200, "text", "thin", "PARTIAL"), (403, "", "", "BLOCKED"), (200, "", "", "PARTIAL"), (200, "", "blocked by site Bot Protection", "BLOCKED"), (None, "", "timeout", "FAILED"), (None, "", "", "PENDING"), (None, None, None, "PENDING"), (500, "", "x", "FAILED"), (None, "", "robots.txt says no", "SKIPPED")]
    df = spark.createDataFrame(rows, "c int, t string, e string, want string")
    assert all(r.got == r.want for r in df.select("want", status.backfill_status(F.col("c"), F.col("t"), F.col("e")).alias("got")).collect())


def test_labels(spark):
    df = spark.createDataFrame([("success", 200, ""), ("odd", 302, ""), (None, None, "x")], "s string, c int, e string")
    got = df.select(status.status_label(F.col("s")).alias("l"), status.status_badge(F.col("s")).alias("b"), status.http_badge(F.col("c"), F.col("e")).alias("h"), status.http_phrase(F.col("c")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("Crawled", "badge badge-ok", "badge badge-ok", "OK"), ("odd", "badge badge-muted", "badge badge-warn", "Found"), ("", "badge badge-muted", "badge badge-error", "")]


def test_transport_errors(spark):
    rows = [("ConnectTimeout", "x", "timeout"), ("ConnectError", "getaddrinfo failed", "dns failure: ConnectError"), ("ConnectError", "SSL: bad", "ssl error: ConnectError"), ("ReadError", "Connection reset by peer", "connection reset: ReadError"), ("ConnectError", "refused", "connection refused: ConnectError"), ("Odd", "boo", "network error: Odd: boo")]
    df = spark.createDataFrame(rows, "k string, m string, want string")
    assert all(r.want == r.got for r in df.select("want", status.describe_transport_error(F.col("k"), F.col("m")).alias("got")).collect())


PAGE = """<html lang=en><head><title>Northwind | Team</title><meta property="og:title" content="Our team"><meta name=description content="People">
<link rel="canonical" href="https://n.example/team"></head><body><nav><a href="/x">Menu</a></nav><h1>Leadership</h1>
<div><a href="/jane"><strong>Jane Doe</strong></a><p>Chief Executive Officer<p>Second para <b>bold</b></div><ul><li>One<li>Two</ul>
<script>var a = "<p>no</p>";</script><footer><p>Foot</p></footer><p>%s</p></body></html>""" % ("long " * 100)


def test_page_extraction():
    p = html.parse(PAGE)
    lines = html.walk_text(p).split("\n\n")
    assert lines == ["# Leadership", "Jane Doe", "Chief Executive Officer", "Second para bold", "- One", "- Two"]
    assert p.meta == {"title": "Northwind | Team", "og:title": "Our team", "description": "People", "canonical": "https://n.example/team", "lang": "en"}


def test_extractor_column_and_plug(spark):
    got = one(spark, PAGE, html.page_extractor())
    assert got.title == "Our team" and got.description == "People" and got.method == "dom"
    assert one(spark, PAGE, html.page_extractor(lambda h: "main " * 80)).method == "main"
    none = one(spark, None, html.page_extractor())
    assert (none.text, none.title, none.method) == ("", "", "none")


def test_choose_extraction():
    assert html.choose_extraction("", "d") == "d" and html.choose_extraction("m", "") == "m"
    assert html.choose_extraction("m" * 100, "d" * 300).startswith("d")
    assert html.choose_extraction("m" * 300, "d" * 700).startswith("d")
    assert html.choose_extraction("m" * 300, "d" * 500).startswith("m")


def test_decode_bytes():
    assert html.decode_bytes("Jos\xe9".encode("latin-1"), 'text/html; charset="iso-8859-1"') == "José"
    assert html.decode_bytes('<meta charset="windows-1252">é'.encode("cp1252")) == '<meta charset="windows-1252">é'
    assert html.decode_bytes("é".encode()) == "é" and html.decode_bytes(b"\xff\xfeA\x00") == "A" and html.decode_bytes(None) == ""


@pytest.mark.parametrize(
    "url,anchor,want",
    [
        ("https://x.example/leadership", "", (100, "leadership")),
        ("https://x.example/about/our_team", "", (92, "our-team")),
        ("https://x.example/a", "Our Leadership", (95, "leadership")),
        ("https://x.example/human-capital-management", "", (53, "management")),
        ("https://x.example/privacy", "", (0, "privacy")),
        ("https://x.example/", "", (10, "")),
        ("https://x.example/about", None, (50, "about")),
    ],
)
def test_link_score(spark, url, anchor, want):
    df = spark.createDataFrame([(url, anchor)], "u string, a string")
    assert tuple(df.select(links.link_score(F.col("u"), F.col("a")).alias("x")).first().x) == want


def test_crawlable(spark):
    rows = [("https://a.example/x", True), ("https://b.example/x", False), ("https://www.a.example/x.PDF", False), ("mailto:x", False), (None, False)]
    df = spark.createDataFrame(rows, "u string, want boolean")
    assert all(r.want == r.got for r in df.select("want", links.is_crawlable(F.col("u"), F.lit("https://a.example/")).alias("got")).collect())


def test_text_functions(spark):
    assert one(spark, " A  b C ", text.squash) == "a b c"
    assert one(spark, "a【1†L9】 [2] [x]", text.citations) == [1, 2]
    assert one(spark, 'sure: {"a": {"b": 1}} done', text.json_object) == '{"a": {"b": 1}}'
    assert one(spark, '```json\n{"a": 1}\n```', text.json_object) == '{"a": 1}'
    assert one(spark, "no json", text.json_object) is None
    assert [one(spark, v, text.clamp_unit) for v in ("1.5", "-1", "0.4", "x", None)] == [1.0, 0.0, 0.4, None, None]
    assert one(spark, "x" * 9000, text.truncate_for_prompt) == "x" * 6000 + text.OMITTED + "x" * 2000
    assert one(spark, "abcdef", lambda c: text.shorten(c, 4)) == "abc…"
    assert one(spark, "a  b\r\n\r\n\r\n c\td", text.clean_document) == "a b\n\nc d"
    assert one(spark, None, text.content_hash) == "" and one(spark, None, text.word_count) == 0
    assert one(spark, None, text.show_time, "timestamp") == "—"


def chunks(t, size=1000, overlap=150):
    return chunking.chunk_normalised(t, size, overlap)


def test_chunker():
    paras = [f"Paragraph {i} " + "word " * 30 for i in range(12)]
    got = chunks("\n\n".join(p.strip() for p in paras))
    assert len(got) > 1 and [c["ordinal"] for c in got] == list(range(len(got))) and all(len(c["text"]) <= 1160 for c in got)
    assert got[1]["text"].startswith(got[0]["text"][-150:].strip())
    long_ = chunks("Sentence one is here. " * 100)
    assert len(long_) >= 3 and all(len(c["text"]) <= 1000 for c in long_)
    heads = chunks("\n\n".join(f"## Person {i}\n\nShort biography line {i}." for i in range(20)))
    assert len(heads) <= 3 and heads[0]["heading"] == "Person 0" and "##" not in heads[0]["text"]
    assert chunks("") == [] and chunks(None) == []
    assert chunks("x" * 2500, 1000)[2]["text"] == "x" * 500


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab #.\n", max_size=400), st.integers(20, 120))
def test_chunk_ordinals_are_dense(t, size):
    got = chunks(t.strip(), size, 10)
    assert [c["ordinal"] for c in got] == list(range(len(got))) and all(c["text"] for c in got)


LEADERS = "# Leadership\n\nJane Smith\n\nChief Executive Officer\n\nDr. Elena Vasquez serves as Chief Financial Officer of Northwind Robotics.\n\nThe Chief Technology Officer is Samuel Okonkwo, who joined.\n\nRead More\n\nOur Team"


def test_people_patterns():
    got = {p["name"]: (p["title"], p["confidence"]) for p in people.pairs_on_page(LEADERS, 3)}
    assert got["Jane Smith"] == ("Chief Executive Officer", 0.6)
    assert got["Elena Vasquez"] == ("Chief Financial Officer", 0.8)
    assert got["Samuel Okonkwo"] == ("Chief Technology Officer", 0.8)
    assert "Read More" not in got and "Our Team" not in got
    assert people.clean_name("Ron Sugar Former CEO") == "Ron Sugar" and people.clean_name("Gary Miller Customer Success") == "Gary Miller"
    assert people.clean_title("president and ceo") == "President and CEO" and people.title_in("Our partner") == ""
    assert people.title_in("Chief Security Officer") == "Chief Security Officer" and people.title_in("x" * 230 + " CEO") == ""
    assert people.pairs_on_page(None, 3) == [] and people.pairs_on_page("Home\nProducts\nContact Us", 3) == []


def test_extract_people_keeps_longest_title(spark):
    df = spark.createDataFrame([(1, "https://acme.example/t", "Jane Smith\nCEO\n\n\n\n\nJane Smith\nChief Executive Officer\nBob Jones\nDirector"), (2, "u", None), (3, "u", "")], "id long, url string, text_content string")
    got = people.extract_people(df).orderBy("rank").collect()
    assert [(r.url_id, r.rank, r.name, r.title) for r in got] == [(1, 1, "Jane Smith", "Chief Executive Officer"), (1, 2, "Bob Jones", "Director")]
    assert got[0].company == "Acme"


def test_infer_company(spark):
    rows = [("Acme Corp | Leadership", "u", "Acme Corp"), ("Our Team – Northwind Robotics", "u", "Northwind Robotics"), ("About Northwind", "u", "Northwind"), ("x", "https://www.apple.com/l", "Apple"), ("x", "http://127.0.0.1/", ""), (None, None, "")]
    df = spark.createDataFrame(rows, "t string, u string, want string")
    assert [(r.want, r.got) for r in df.select("want", people.infer_company(F.col("t"), F.col("u")).alias("got")).collect() if r.want != r.got] == []


def test_leadership_page(spark):
    df = spark.createDataFrame([("# Our Team\nx", "https://x/1", True), ("a page about shipping", "https://x/1", False), ("", "https://x/leadership", True), (None, None, False)], "t string, u string, want boolean")
    assert all(r.want == r.got for r in df.select("want", people.is_leadership_page(F.col("t"), F.col("u")).alias("got")).collect())


def test_embeddings(spark):
    v = one(spark, "alpha beta beta", vectors.embed)
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-9
    assert sum(one(spark, None, vectors.embed)) == 0
    native = one(spark, "alpha beta beta", vectors.token_weights)
    assert sorted(set(native)) == sorted(i for i, x in enumerate(v) if x)
    assert one(spark, [3.0, 4.0], vectors.unit, "array<double>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vectors.unit, "array<double>") == [0.0, 0.0]
