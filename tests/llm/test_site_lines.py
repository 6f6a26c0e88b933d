"""Problem 3 against brute force."""

import collections
import random
import re

from lodestack.llm import site_lines as s

PAGES = "id long, normalized_url string, domain string, text_content string, site string, key string, h long"


def brute(rows, least=5):
    seen, occ = collections.defaultdict(set), []
    for i, url, _, t, *_ in rows:
        m = re.match(r"\w+://([^/?#]*)", url or "")
        site = re.sub(r"^www\.", "", m.group(1).lower()) if m else ""
        if i is None or not t or not site:
            continue
        for no, line in enumerate(t.split("\n"), 1):
            k = "".join(c for c in line.lower() if c.isalpha())
            if k:
                seen[site, k].add(i)
                occ.append((i, no, (site, k)))
    return {(i, no) for i, no, k in occ if len(seen[k]) >= least}


def rows():
    rnd = random.Random(3)
    lines = ["Imprint | Privacy", "© 2020 Ächme", "12345", "", "Share this!", "SHARE THIS 7", "İstanbul", "日本語の行"]
    out = [(i, f"https://{rnd.choice(['www.', ''])}{rnd.choice(['big.example', 'big.example', 'b.example', 'c.example'])}/p{i}", None, "\n".join(rnd.choice([*lines, f"unique {rnd.random()}"]) for _ in range(rnd.randrange(9))) + rnd.choice(["", "\r\nImprint - Privacy\r"]), "x", "y", 1) for i in range(60)]
    return out + [(900, None, None, "Share this!", None, None, None), (901, "https://b.example/", None, None, None, None, None), (None, "https://big.example/x", None, "Share this!", None, None, None)]


def test_against_brute_force(spark):
    data = rows()
    got = [(r.id, r.line_no) for r in s.repeated_lines(spark.createDataFrame(data, PAGES)).collect()]
    assert set(got) == brute(data) and len(got) == len(set(got)) > 30


def test_repeated_ids_count_once(spark):
    data = [(1, "https://a.example/1", None, "same line", None, None, None)] * 9 + [(i, "https://a.example/x", None, "other line\nother line", None, None, None) for i in range(5)]
    assert {(r.id, r.line_no) for r in s.repeated_lines(spark.createDataFrame(data, PAGES)).collect()} == brute(data) == {(i, n) for i in range(5) for n in (1, 2)}


def test_clean_and_blocks(spark):
    data = [(i, "https://a.example/x", None, f"Body text of page {'abcdefgh'[i]}.\nImprint\nPrivacy\n\nTail", None, None, None) for i in range(8)]
    df = spark.createDataFrame(data, PAGES)
    clean = {r.id: (r.clean_text, r.removed_lines) for r in s.without_repeated_lines(df).collect()}
    assert clean[3] == ("Body text of page d.\n", 3)
    b = s.line_blocks(df).collect()
    assert len(b) == 1 and b[0].lines == ["imprint", "privacy", "tail"] and b[0].support == 8
    assert s.without_repeated_lines(spark.createDataFrame([(1, "https://a/x", None, None, None, None, None)], PAGES)).first().clean_text is None
    empty = spark.createDataFrame([], PAGES)
    assert s.repeated_lines(empty).count() == 0 and s.line_blocks(empty).count() == 0


def test_occurrences_are_deleted_by_block(spark):
    """Each deleted line is one of a block: neighbours on enough pages share it, a line beside too few stands alone."""
    data = [(i, "https://a.example/x", None, f"Body {'abcdefgh'[i]}\nImprint\nPrivacy\nMiddle {'abcdefgh'[i]}\n\n7\nLone line", None, None, None) for i in range(8)]
    got = {(r.id, r.line_no): r.block for r in s.repeated_lines(spark.createDataFrame(data, PAGES), keep=("block",)).collect()}
    assert set(got) == brute(data) == {(i, n) for i in range(8) for n in (2, 3, 7)}
    assert len({got[i, n] for i in range(8) for n in (2, 3)}) == 1 and len({got[i, 7] for i in range(8)}) == 1 and got[0, 7] != got[0, 2]
