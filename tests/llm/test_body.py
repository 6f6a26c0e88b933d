"""Problem 2: regions, forms, evidence of forms and places."""

import numpy as np

from lodestack.llm import body as b

HTML = """<html><head><title>T</title><script>x="<p>no</p>"</script></head><body><div class="top"><p>We and 12 partners use cookies to keep this site running. Manage choices</p>
<a href="/1">Home</a><a href="/2">Research</a></div><div class="text"><h1>%s</h1><p>%s</p><p>%s</p><h2>Departments</h2><ul><li>Fishing</li><li>Legal</li></ul></div>
<div class="side"><h3>You may also like</h3><a href="/4">%s</a></div><div class="low"><p>Share: mail, print, copy link</p><p>&copy; 2020 Foo Bar. All rights reserved.</p></div>"""
TEXT = """We and 12 partners use cookies to keep this site running. Manage choices
Home
Research

%s
%s
%s
Departments
Fishing
Legal
You may also like
%s
Share: mail, print, copy link
© 2020 Foo Bar. All rights reserved."""
GONE = {1, 2, 3, 11, 12, 13, 14}
PEOPLE = ["Anna Quill", "Bert Moor", "Cora Dahl", "Dan Eck", "Ella Fjord", "Finn Gast", "Gina Holm", "Hal Ibsen"]
PAGES = "id long, title string, text_content string, raw_html string, normalized_url string, line_no string, body string, site string"


def parts(i):
    who, next_ = PEOPLE[i % len(PEOPLE)], PEOPLE[(i + 3) % len(PEOPLE)]
    return (
        f"{who} takes over the harbour",
        f"The board of Foo Bar appointed {who} after a search of {i + 2} months and letter number {i * 7} from friends {chr(97 + i) * 5}.",
        f"In March the {chr(97 + i) * 6} harbour opened quay {i}, and many people found work {chr(98 + i) * 4} there in spring.",
        f"{next_} takes over the harbour",
    )


def page(i, html=True, site="foo.example"):
    p = parts(i)
    return (i, p[0], TEXT % p, HTML % p if html is True else html, f"https://www.{site}/{i}", "x", "y", "z")


def gone(spark, rows):
    return sorted((r.id, r.line_no) for r in b.furniture_lines(spark.createDataFrame(rows, PAGES)).collect())


def test_site_with_and_without_html(spark):
    rows = [page(i) for i in range(6)] + [page(6, None), page(7, (HTML % parts(7))[:420])]
    got = gone(spark, rows)
    assert [x for x in got if x[0] < 6] == [(i, n) for i in range(6) for n in sorted(GONE)]
    for i in (6, 7):  # evidence of the other pages serves where the page's own HTML is missing
        assert {n for j, n in got if j == i} >= {1, 2, 3, 12, 13, 14} and not {n for j, n in got if j == i} & {5, 6, 7}


def test_line_ends_and_capitals(spark):
    rows = [page(i) for i in range(5)]
    i, title, text, *rest = page(5)
    rows.append((i, title, text.replace("Share: mail", "SHARE:  MAIL").replace("\n", "\r\n"), *rest))
    assert gone(spark, rows) == [(i, n) for i in range(6) for n in sorted(GONE)]


def test_regions_decide():
    """Without the clusters' verdict nothing but named lines and headline forms would go."""
    got = b.page_features(page(0)[2], page(0)[3], page(0)[1], "foo.example")
    no, _, _, _, group, ratio, kind, bits = (np.array(x) for x in zip(*got))
    content = b.line_regions(np.zeros(len(no), int), group.astype(np.uint32).view(np.int32), ratio, kind, bits, np.isin(no, [1, 13, 14]))  # the site's own lines
    assert set(no[content].tolist()) == {5, 6, 7, 8, 9, 10}


def test_decoys_are_body(spark):
    t = "Anna Quill takes over the harbour\nA word on cookies: Jennifer bakes 198 of them for the fair in Fennholm and her friends.\nSubscribe, share, follow: with these words Anna Quill opened the archive in Dorn."
    assert gone(spark, [(1, "Anna Quill takes over the harbour", t, None, "https://a.example/", "", "", "")]) == []


def test_page_without_content_keeps_its_message(spark):
    t = "Home\nAccess denied. You do not have permission to open this page. Incident 12\nImprint | Privacy | Terms"
    assert gone(spark, [(1, None, t, None, None, "", "", "")]) == [(1, 1), (1, 3)]


def test_forms():
    assert b.form("How Foo Bar S.A. won quieter machines") == b.form("How Other Ltd won quieter machines. And more text of the page follows.")
    assert b.form("Founded: 1973") == b.form("Founded: 2001") != b.form("Closed: 1973")
    assert b.form("Profile of Ann Bo, Chair, Ulm") == b.form("Profile of Al Wu, Clerk, Bonn") != b.form("Anna of Ulm, Chair, Bonn")
    assert b.form("") == b.form("!!!") == ": "


def test_smoothing_and_regions():
    one = np.zeros(7, int)
    k = b.smoothed(np.array([0, 0, 0, 10.0, 0, 0, 0]), one, 1.5)
    assert k.argmax() == 3 and k[2] > 0
    assert b.smoothed(np.array([5.0, 0, 0]), np.array([0, 1, 1])).tolist() == [5, 0, 0]  # not over the edge of a container
    r = b.content_regions(np.array([2, 3, 2, 3, 2, 200, 220, 180, 210, 2, 3, 2.0, 7, 7]), np.array([0] * 12 + [1] * 2))
    assert r.tolist() == [False] * 5 + [True] * 4 + [False] * 3 + [True] * 2
    assert b.content_regions(np.array([]), np.array([])).tolist() == []


def test_rendered_lines():
    got = b.rendered_lines("<div class=x><p>a &amp; <b>b</b></p></div><div><a href=x>menu</a> <span onclick=go(1)>t</span><script>no</script>")
    assert [(t, place, leaf) for t, _, _, place, leaf in got] == [("a & b", "div class=x", "p"), ("menu t", "", "a")] and got[1][2] == 5


def test_operator_on_dirt(spark):
    long_ = "\n".join(f"Sentence number {i} of a very long page that goes on and on." for i in range(4000))
    rows = [page(i) for i in range(1, 6)]
    rows += [(11, None, None, None, None, None, None, None), (12, "", "", "<p", None, None, None, None), (13, "t", long_, None, "x", None, None, None), (14, "t", "\n \n", "x", None, None, None, None), (None, "t", "Home", None, None, None, None, None), page(1)]
    df = spark.createDataFrame(rows, PAGES)
    got = [(r.id, r.line_no) for r in b.furniture_lines(df).collect()]
    assert sorted(got) == [(i, n) for i in range(1, 6) for n in sorted(GONE)]  # rows that are there twice are one page
    bodies = [(r.id, r.body) for r in b.page_bodies(df).collect()]
    assert (11, None) in bodies and (12, "") in bodies and any(i == 13 and len(x) == len(long_) for i, x in bodies) and len(bodies) == 11
    assert {x for i, x in bodies if i == 1} == {"\n".join(x for n, x in enumerate(page(1)[2].split("\n"), 1) if n not in GONE)}
    assert b.furniture_lines(df.limit(0)).count() == 0
