"""Problem 4: placeholders, filler and messages beside texts that only speak of them."""

import pytest

from lodestack.llm import residue as r

CASES = [
    ("Welcome, {{first_name}} and hello", "placeholder"),
    ("asked for {{person.bio|default}} the rest", "placeholder"),
    ("the [[department]] team", "placeholder"),
    ("@@join_date@@", "placeholder"),
    ("Name %REGION%", "placeholder"),
    ("with %(title)s in", "placeholder"),
    ("by ${office} demand", "placeholder"),
    ("<%= city %>", "placeholder"),
    ("{% block title %}", "placeholder"),
    ("hi {last_name}", "placeholder"),
    ("__COMPANY__ works", "placeholder"),
    ("##BIO## x", "placeholder"),
    ("new «company name» returns", "placeholder"),
    ("the <start date> figure", "placeholder"),
    ("[Insert short biography here]", "placeholder"),
    ("for [NAME OF OFFICER] the", "placeholder"),
    ("EMAIL_GOES_HERE", "placeholder"),
    ("your headline goes here now", "placeholder"),
    ("Lorem ipsum dolor sit amet", "filler"),
    ("Ipsum amet velit dolor morbi cursus tempora velit amet dolor velit cursus morbi", "filler"),
    ("Wobble gronk flarn pimmel trask wem flarn gronk dorp wem trask gronk pimmel flarn wem", "filler"),
    ("asdf test foo asdf blah xxx", "filler"),
    ("Dummy content for layout check 12: x", "filler"),
    ("Heading 1\n\nSubheading 2\n\nBody copy to be supplied by x", "filler"),
    ("This is sample text for the bio block.", "filler"),
    ("Type your title here. Remove this hint when done.", "filler"),
    ("Error 404: the page you asked for could not be found.", "message"),
    ("Menu\nAccess denied. You do not have permission to open this page. Incident 77\n© 2020 X", "message"),
    ("Please switch on JavaScript to view this directory.", "message"),
    ("Your session has ended. Sign in again to see this profile.", "message"),
    ("410\nBack to start", "message"),
    ("java.lang.NullPointerException\n\tat org.sample.Handler.run(Handler.java:1)", "message"),
    ("Traceback (most recent call last):\n  File \"/srv/x.py\", line 3\nKeyError: 'bio'", "message"),
    ("Checking the connection before you enter. Request ID 1b0d0265", "message"),
    ("Seite nicht gefunden. Die gewünschte Adresse (404) gibt es nicht mehr.", "message"),
    ("Veuillez activer les scripts dans votre navigateur pour continuer.", "message"),
    ("Lo sentimos, la página solicitada no existe (error 404).", "message"),
    # real content
    ("Omar explains that the marker `{{ city }}` is filled in when the letters are printed.", None),
    ("The exhibition “Page Not Found” by Ngozi shows 313 lost maps.", None),
    ("“Something went wrong with our winter tyres,” admits Nicholas, and Gatix paid for 244 sets.", None),
    ("Access to the archive in Jostbridge was denied to Kenneth until Funsteda lent 4 guards.", None),
    ("Error rates at Korbimu fell to 13 per thousand, reports Katherine.", None),
    ("The placeholder price of 4 euros was replaced after Yusuf called.", None),
    ("Łukasz teaches JavaScript in Craiona and says most pupils enjoy it.", None),
    ("In 1999 room 404 at Sontrulo was where they met.", None),
    ("« À Josthaven, nous avons appris à réparer avant de remplacer », explique Omar.", None),
    ("x = {'a': 1}; return x; a < b and c > d [1] [Jane] 100% of 20%", None),
    ("", None),
    (None, None),
    ("  \n ", None),
    ("a word of the text " * 50_000, None),
]
FETCH = "fetch_id long, url string, text string, row_id string, source string"
PAGES = "id long, normalized_url string, text_content string, text string, reason string"


def test_cases(spark):
    f = spark.createDataFrame([(i, f"https://s{i}.example/", t, "x", "y") for i, (t, _) in enumerate(CASES)], FETCH)
    p = spark.createDataFrame([(i, f"https://s{i}.example/", t, "x", "y") for i, (t, _) in enumerate(CASES)], PAGES)
    got = {(x.table_name, x.row_id): x.reason for x in r.residue_rows(f, p).collect()}
    for table in ("fetch_results", "harvested_urls"):
        wrong = [(t, want, got.get((table, i))) for i, (t, want) in enumerate(CASES) if got.get((table, i)) != want]
        assert wrong == []


def test_unknown_message_is_found_by_recurrence(spark):
    line = "The robots guard of this site wants request id {} before anything else is shown"
    rows = [(i, f"https://s{i}.example/x", line.format(i * 31), "", "") for i in range(4)] + [(9, "https://s9.example/x", "The robots in hall 9 are painted blue", "", "")]
    none = spark.createDataFrame([], PAGES)
    assert {x.row_id for x in r.residue_rows(spark.createDataFrame(rows, FETCH), none).collect()} == {0, 1, 2, 3}
    assert r.residue_rows(spark.createDataFrame(rows[:2], FETCH), none).count() == 0
    assert r.residue_rows(spark.createDataFrame([], FETCH), none).count() == 0


@pytest.mark.parametrize("line,hit", [("Error 503: the file you asked for could not be found.", True), ("Welcome, {{x}}", True), ("410", True), ("Home", False), ("A plain sentence.", False), ("test text test text", True), ("   at a.b.C(D.java:3)", True)])
def test_line_pattern(line, hit):
    assert r.is_residue_line(line) == hit and r.is_residue_line(line + " " * 300) == hit


@pytest.mark.parametrize("n", [1, 100, 5000])
def test_residue_is_found_in_texts_of_any_length(spark, n):
    pad = "\n".join(f"Line {i} of the report on the harbour and its {i} boats." for i in range(n))
    rows = [(i, f"https://s{i}.example/", f"{pad}\n{t}\n{pad}", "", "") for i, t in enumerate(["test text test text", "Error 404: the page you asked for could not be found.", "by ${office} demand"])]
    got = {x.row_id: x.reason for x in r.residue_rows(spark.createDataFrame(rows, FETCH), spark.createDataFrame([], PAGES)).collect()}
    assert got == {0: "filler", 1: "message", 2: "placeholder"}


def test_what_recurs_beside_content_is_no_message(spark):
    content = "The board of the harbour met on Monday and {} agreed on the plan for the second quay, which the people of the town had asked for in {} letters to the mayor and to the council of the region since spring."
    rows = [(i, f"https://s{i}.example/", f"Our newsletter\n{content.format(chr(97 + i) * 5, i)}", "", "") for i in range(6)] + [(9, "https://s9.example/", "Our newsletter", "", "")]
    assert r.residue_rows(spark.createDataFrame(rows, FETCH), spark.createDataFrame([], PAGES)).count() == 0


def test_hints_hold_for_every_rule():
    for hints, p in (*r.PLACEHOLDERS, *r.FILLERS):
        for t, reason in CASES:
            if reason in ("placeholder", "filler") and t and __import__("re").search(p, t):
                assert any(h in t.lower() for h in hints)


def test_phrase_rules_need_no_vocabulary_and_long_lines_recur(spark):
    named = ["Sorry, this page does not exist.", "Sorry, this page has been removed.", "Oops! That page does not exist", "401 Unauthorized", "Please enable cookies to continue.", "Something went wrong. Please try later."]
    long_ = "This request {} was stopped by the guard before the page and its " + "very " * 50 + "long notice on your browser"
    rows = [(i, f"https://s{i}.example/", f"Menu\n{t}", "", "") for i, t in enumerate(named)] + [(20 + i, f"https://t{i}.example/", long_.format(i), "", "") for i in range(3)] + [(30, "https://u.example/", "Sorry, this page of his diary does not exist in print, says Omar.", "", "")]
    got = {x.row_id for x in r.residue_rows(spark.createDataFrame(rows, FETCH), spark.createDataFrame([], PAGES)).collect()}
    assert got == {*range(6), 20, 21, 22}
