"""Problem 8 against brute force."""

import itertools
import random
import re

import numpy as np

from lodestack.llm import spans as s

DOCS = "doc_id long, text string, k long, at string"


def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def rows():
    rnd = random.Random(9)
    abc = "abcdefghijklmnopqrstuvwxyz      .,äé日🙂"
    noise = lambda n: "".join(rnd.choice(abc) for _ in range(n))
    out = []
    for i, n in enumerate((150, 195, 198, 199, 200, 201, 207, 230, 420)):
        p = noise(n)
        out += [(10 * i + 1, noise(rnd.randrange(120)) + "<" + p + ">" + noise(90), 0, ""), (10 * i + 2, noise(rnd.randrange(120)) + "[" + p + "]" + noise(50), 0, "")]
    whole = noise(500)
    out += [(200, whole, 0, ""), (201, whole, 0, ""), (202, whole, 0, ""), (203, "x" + whole[100:330], 0, ""), (204, whole[:199], 0, ""), (205, whole[:199], 0, "")]
    out += [(300, "a" * 700, 0, ""), (301, "b" + "a" * 205, 0, ""), (302, "ab" * 300, 0, ""), (303, "c" + "ab" * 110, 0, "")]
    return out + [(400, None, 0, ""), (401, "", 0, ""), (402, " ", 0, ""), (None, whole, 0, ""), (200, whole, 0, "")]


def test_pairs_against_brute_force(spark):
    data = rows()
    texts = {(i, t) for i, t, *_ in data if i is not None and t}
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(sorted(texts), 2) if a != b and longest_common(x, y) >= 200}
    got = [tuple(r) for r in s.shared_pairs(spark.createDataFrame(data, DOCS)).collect()]
    assert set(got) == want and len(got) == len(set(got))
    assert (41, 42) in want and (31, 32) not in want


def test_every_common_span_has_a_common_cut():
    rnd = random.Random(1)
    roller = s.Roller()
    for _ in range(60):
        p = "".join(rnd.choice("ab c") for _ in range(s.MIN_SPAN))
        hashes = []
        for _ in range(2):
            t = "".join(rnd.choice("abc d") for _ in range(rnd.randrange(300))) + p + "".join(rnd.choice("abc d") for _ in range(rnd.randrange(300)))
            codes, ends = s._joined([t, "pad" * 90])
            at, h = s.cut_points(codes, np.concatenate(([0], ends[:-1])), ends, roller)
            hashes.append(set(h.tolist()))
        assert hashes[0] & hashes[1]


def test_report_and_clean(spark):
    rnd = random.Random(4)
    say = lambda: "The " + "".join(rnd.choice("abcdefghij ") for _ in range(70)).strip() + ". "
    shared = "".join(say() for _ in range(6))
    a, b = say() * 1 + shared + say(), say() + shared + say()
    docs = spark.createDataFrame([(1, a, 0, ""), (2, b, 0, ""), (3, say() * 2, 0, ""), (4, None, 0, ""), (5, a, 0, "")], DOCS)
    rep = {r.doc_id: r for r in s.shared_report(docs).collect()}
    assert rep[1].shared_chars == len(a) and rep[5].shared_part == 1.0 and rep[3].shared_chars == 0 and rep[4].shared_part == 0
    assert abs(rep[2].shared_chars - len(shared)) <= 2 * s.STEP
    clean = {r.doc_id: r.clean_text for r in s.shared_clean(docs).collect()}
    assert clean[1] == a and clean[5] == "" and clean[4] is None and clean[3] is not None
    assert shared[120:300] not in clean[2] and clean[2].startswith(b[:40]) and len(clean[2]) < len(b) - 300


def test_empty_and_huge(spark):
    empty = spark.createDataFrame([], DOCS)
    assert s.shared_pairs(empty).count() == 0 and s.shared_report(empty).count() == 0
    big = "".join(random.Random(6).choice("abcdefgh ") for _ in range(400_000))
    docs = spark.createDataFrame([(1, big, 0, ""), (2, "zz" + big[200_000:200_400], 0, "")], DOCS)
    assert [tuple(r) for r in s.shared_pairs(docs).collect()] == [(1, 2)]


def test_clean_and_report_are_exact(spark):
    """Against brute force: every sentence under runs of 200 that an earlier document holds goes, no other."""
    rnd = random.Random(12)
    say = lambda n: "The " + "".join(rnd.choice("abcdefghij ") for _ in range(n)).strip() + ". "
    few = lambda k: "".join(say(rnd.randrange(40, 90)) for _ in range(k))
    data = []
    for g in range(40):
        p = few(rnd.choice((2, 3, 4, 6)))
        data += [(10 * g + i, few(rnd.randrange(3)) + (p if i < 3 else p[rnd.randrange(60) : -rnd.randrange(1, 60)]) + few(rnd.randrange(3)), 0, "") for i in range(5)]
    data += [(9000, "q" * 20 + data[0][1][:199], 0, ""), (9001, "ab" * 300, 0, ""), (9002, "c" + "ab" * 130 + ". End.", 0, "")]
    grams = lambda t: {t[i : i + s.MIN_SPAN] for i in range(len(t) - s.MIN_SPAN + 1)}
    held, want_clean, want_n = {i: grams(t) for i, t, *_ in data}, {}, {}
    under = lambda t, others: {j for i in range(len(t) - s.MIN_SPAN + 1) if t[i : i + s.MIN_SPAN] in others for j in range(i, i + s.MIN_SPAN)}
    texts = {t for _, t, *_ in data}
    assert len(texts) > 100
    for i, t, *_ in data:
        same = len(t) >= s.MIN_SPAN and [j for j, u, *_ in data if u == t and j < i]
        gone = under(t, set().union(*(h for j, h in held.items() if j < i)))
        want_n[i] = len(under(t, set().union(*(h for j, h in held.items() if j != i))))
        parts, start = [], 0
        for m in [*re.finditer(s.SENTENCE_END, t), None]:
            stop = m.start() if m else len(t)
            if stop == start or not gone.issuperset(range(start, stop)):
                parts.append(t[start : m.end() if m else stop])
            start = m.end() if m else stop
        want_clean[i] = "" if same else "".join(parts)
    docs = spark.createDataFrame(data, DOCS)
    assert {r.doc_id: r.shared_chars for r in s.shared_report(docs).collect()} == want_n
    assert {r.doc_id: r.clean_text for r in s.shared_clean(docs).collect()} == want_clean
