"""Sheets, documents, fetching and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestack.settings import Settings
from lodestack.sources import documents, fetching, sheets
from lodestack.streaming import incremental


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_csv(spark, tmp_path):
    df = sheets.read_sheet(spark, write(tmp_path / "a.csv", 'ID,URL,URL,\n1,"https://a.example/x,y", z ,q,extra\n,,,\n2,https://b.example\n'))
    assert df.columns == ["ID", "URL", "URL_1", "column_3"]
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [("1", "https://a.example/x,y", "z", "q"), ("2", "https://b.example", "", "")]
    assert sheets.detect_url_column(df) == "URL"


def test_delimiters_and_encodings(spark, tmp_path):
    assert sheets.read_sheet(spark, write(tmp_path / "b.csv", b"\xef\xbb\xbfName;Website\nJos\xc3\xa9;https://a.example\n")).first().asDict() == {"Name": "José", "Website": "https://a.example"}
    assert sheets.read_sheet(spark, write(tmp_path / "c.csv", b"Name,Link\nJos\xe9,https://a.example\n")).first().Name == "José"
    assert sheets.read_sheet(spark, write(tmp_path / "d.tsv", "a\tb\n1\t2,3\n")).first().b == "2,3"
    with pytest.raises(sheets.SheetError):
        sheets.read_sheet(spark, str(tmp_path / "x.xls"))
    with pytest.raises(sheets.SheetError):
        sheets.read_sheet(spark, write(tmp_path / "e.csv", b"  "))


def test_url_column_needs_half(spark):
    df = spark.createDataFrame([("https://a.example", "x", None), ("no", "https://b.example", None), ("no", "https://c.example", "")], "Website string, other string, blank string")
    assert sheets.detect_url_column(df) == "other"
    assert sheets.detect_url_column(df.select("blank")) is None
    assert sheets.unique_headers(["a", "a", "a_1", ""]) == ["a", "a_1", "a_1_1", "column_3"]


def xlsx(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda r, i: "".join(f'<c r="{"ABCD"[j]}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{"ABCD"[j]}{i}"><v>{v}</v></c>' for j, v in enumerate(r) if v is not None)
    body = "".join(f'<row r="{i}">{cells(r, i)}</row>' for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    df = sheets.read_sheet(spark, write(tmp_path / "a.xlsx", xlsx([["ID", None, "URL"], [1, 2.5, "https://a.example"], [None, None, " "], [3, None, None]])))
    assert df.columns == ["ID", "column_1", "URL"]
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [("1", "2.5", "https://a.example"), ("3", "", "")]
    with pytest.raises(Exception):
        sheets.read_sheet(spark, write(tmp_path / "bad.xlsx", b"x")).count()


def docx(paras, table=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paras)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}<w:tbl>{t}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_documents(spark, tmp_path):
    rows = [("docx", docx([("Heading1", "Team"), ("Normal", "Jane"), ("Normal", " ")], [("CEO", "Jane"), ("", "")]), "a"), ("text", "caf\xe9\r\n\r\n\r\n\r\nx".encode("cp1252"), "b"), ("docword", b"x", "c"), ("docx", b"x", "d"), ("text", b" ", "e"), (None, None, "f")]
    got = {r.url: r for r in documents.extract_documents(spark.createDataFrame(rows, "kind string, content binary, url string")).collect()}
    assert got["a"].text == "## Team\n\nJane\n\nCEO | Jane" and got["b"].text == "café\n\nx"
    assert got["c"].error.startswith("legacy .doc") and got["d"].crawl_status == "FAILED" and got["e"].error.startswith("no extractable") and got["f"].crawl_status == "FAILED"
    same = spark.createDataFrame([("text", b"x", "u1"), ("text", b"x", "u2"), ("text", b"y", "u3")], "kind string, content binary, url string")
    assert documents.store_documents(same, str(tmp_path / "store")).select("digest").distinct().count() == 2
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_pdf_is_optional():
    with pytest.raises(ValueError):
        documents.pdf_text(b"x")


@pytest.mark.parametrize("ct,url,want", [("application/pdf; x", "u", "pdf"), ("application/octet-stream", "https://x/a.PDF?v=1", "pdf"), ("text/html", "https://x/a", None), (None, "https://x/a.docx#p", "docx"), ("image/png", "https://x/a.png", None), ("text/plain", None, "text")])
def test_kinds(spark, ct, url, want):
    df = spark.createDataFrame([(ct, url)], "c string, u string")
    r = df.select(documents.detect_kind(F.col("c"), F.col("u")).alias("k"), documents.is_unsupported_binary(F.col("c")).alias("b")).first()
    assert r.k == want and r.b == (ct in ("application/octet-stream", "image/png"))


def test_retries():
    calls = []

    def flaky(url):
        calls.append(url)
        return fetching.Response(503 if len(calls) == 1 else 200)

    r, n = fetching.fetch_with_retries(flaky, "u", Settings(), sleep=lambda s: None)
    assert (r.status_code, n) == (200, 2)

    def tls(url):
        raise OSError("certificate verify failed")

    assert fetching.fetch_with_retries(tls, "u", Settings(), sleep=lambda s: None)[1] == 1
    assert fetching.fetch_with_retries(lambda u: fetching.Response(429), "u", Settings(), sleep=lambda s: None)[1] == 3
    assert fetching.backoff_s(3, 0.75) == 3.0


def test_fetch_all(spark):
    cap = fetching.CaptureFetcher({"https://a.example/1": fetching.Response(200, "text/html", b"abc")})
    df = spark.createDataFrame([("https://a.example/1",), ("http://localhost/",), ("https://b.example/",), (None,)], "url string")
    got = {r.url: r for r in fetching.fetch_all(df, cap, Settings(max_retries=0, crawl_delay_s=0.0)).collect()}
    assert bytes(got["https://a.example/1"].body) == b"abc" and "private" in got["http://localhost/"].error and got["https://b.example/"].status_code is None and got[None].error == "empty URL"


def test_robots(spark):
    rows = [("User-agent: *\nDisallow: /x", 200, "https://a/x/1", False), ("User-agent: *\nDisallow: /x", 200, "https://a/y", True), ("User-agent: *\nDisallow: /", 404, "https://a/y", True), (None, None, "https://a/y", True)]
    df = spark.createDataFrame(rows, "r string, c int, u string, want boolean")
    check = fetching.robots_allowed()
    assert all(r.want == r.got for r in df.select("want", check("r", "c", "u").alias("got")).collect())


def test_engine_choice(spark):
    df = spark.createDataFrame([(100, True, 200), (100, True, 120), (100, False, 500), (100, None, 500)], "c int, q boolean, r int")
    assert [r.x for r in df.select(fetching.rerendered_wins(F.col("c"), F.col("q"), F.col("r")).alias("x")).collect()] == [True, False, False, False]

    def down(url):
        raise OSError("connection refused")

    two = fetching.CaptureFetcher({"https://a.example/1": fetching.Response(200, "text/html", b"two")})
    urls = spark.createDataFrame([("https://a.example/1",), ("https://a.example/2",)], "url string")
    quick = Settings(max_retries=0, crawl_delay_s=0.0)
    got = {r.url: r for r in fetching.fetch_all(urls, down, quick, second=two).collect()}
    assert bytes(got["https://a.example/1"].body) == b"two" and got["https://a.example/1"].attempts == 2 and got["https://a.example/2"].status_code is None


def test_robots_in_the_fetch_path(spark):
    cap = fetching.CaptureFetcher({
        "https://a.example/robots.txt": fetching.Response(200, "text/plain", b"User-agent: *\nDisallow: /private/"),
        "https://a.example/private/x": fetching.Response(200, "text/html", b"secret"), "https://a.example/open": fetching.Response(200, "text/html", b"open"),
        "https://b.example/robots.txt": fetching.Response(503), "https://b.example/private/x": fetching.Response(200, "text/html", b"b"),
    })
    urls = spark.createDataFrame([("https://a.example/private/x",), ("https://a.example/open",), ("https://b.example/private/x",)], "url string")
    quick = Settings(max_retries=0, crawl_delay_s=0.0)
    got = {r.url: r for r in fetching.fetch_all(urls, cap, quick).collect()}
    shut = got["https://a.example/private/x"]
    assert (shut.status_code, shut.attempts, shut.error) == (None, 0, fetching.ROBOTS_REASON)
    assert bytes(got["https://a.example/open"].body) == b"open" and bytes(got["https://b.example/private/x"].body) == b"b"
    from lodestack.operators.harvest import extract_pages

    assert {r.url: r.crawl_status for r in extract_pages(fetching.fetch_all(urls, cap, quick), quick).collect()}["https://a.example/private/x"] == "SKIPPED"
    free = Settings(max_retries=0, crawl_delay_s=0.0, respect_robots=False)
    assert all(r.body for r in fetching.fetch_all(urls, cap, free).collect())


def test_addresses_are_checked_before_fetching(spark):
    cap = fetching.CaptureFetcher({"https://in.example/": fetching.Response(200, "text/html", b"x"), "https://out.example/": fetching.Response(200, "text/html", b"y")})

    def resolver(host):
        if host == "gone.example":
            raise OSError("no such host")
        return {"in.example": ["93.184.216.34", "10.0.0.7"], "out.example": ["93.184.216.34"]}[host]

    urls = spark.createDataFrame([("https://in.example/",), ("https://out.example/",), ("https://gone.example/",)], "url string")
    got = {r.url: r for r in fetching.fetch_all(urls, cap, Settings(max_retries=0, crawl_delay_s=0.0), resolver=resolver).collect()}
    assert "private" in got["https://in.example/"].error and got["https://in.example/"].attempts == 0
    assert bytes(got["https://out.example/"].body) == b"y" and got["https://gone.example/"].attempts == 1


def test_bodies_are_read_no_further_than_the_cap():
    read = []

    def pieces():
        for _ in range(1000):
            read.append(1)
            yield b"x" * 10

    assert fetching.capped(pieces(), 35) == b"x" * 35 and len(read) == 4
    assert fetching.capped(None, 5) == b"" and fetching.capped(b"abcdefgh", 3) == b"abc"


def test_pdf_pages_that_cannot_be_read_are_empty():
    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            if self.text is None:
                raise KeyError("font")
            return self.text

    class Book:
        is_encrypted = False
        metadata = type("Info", (), {"title": "T", "author": None, "subject": "s" * 900})()

        def __init__(self, _):
            self.pages = [Page("one"), Page(None), Page("  "), Page("four")]

    text, meta = documents.pdf_text(b"", Book)
    assert text == "## Page 1\n\none\n\n## Page 4\n\nfour"
    assert meta == {"document_kind": "pdf", "pages": "4", "pages_without_text": "2", "pdf_title": "T", "pdf_subject": "s" * 500}


def test_rerendered_pages_replace_thin_ones(spark):
    from lodestack.operators.harvest import rerendered

    cols = "url string, crawl_status string, char_count int, text string"
    plain = spark.createDataFrame([("a", "PARTIAL", 100, "x"), ("b", "PARTIAL", 100, "x"), ("c", "SUCCESS", 900, "x")], cols)
    seen = spark.createDataFrame([("a", "SUCCESS", 600, "y"), ("b", "SUCCESS", 120, "y")], cols)
    assert {r.url: r.text for r in rerendered(plain, seen).collect()} == {"a": "y", "b": "x", "c": "x"}


def test_index_stream(spark, small, tmp_path):
    import shutil

    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{small}/harvested_urls.parquet", src / "one.parquet")
    run = lambda: incremental.index_stream(incremental.page_stream(spark, str(src)), str(tmp_path / "ix"), str(tmp_path / "cp"))
    q = run()
    q.awaitTermination(120)
    n = incremental.current_chunks(spark, str(tmp_path / "ix")).count()
    assert n > 100 and spark.read.parquet(str(tmp_path / "ix/vectors")).count() == n
    assert incremental.progress(q)["active"] is False
    run().awaitTermination(120)  # nothing new: nothing indexed again
    assert incremental.current_chunks(spark, str(tmp_path / "ix")).count() == n
