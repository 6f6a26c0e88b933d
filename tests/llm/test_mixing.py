"""Problem 7: budgets and prefixes."""

import pytest

from lodestack.llm import mixing as m

DOCS = "doc_id long, text string, lang string, source string, n_tokens long, copies string"
WEIGHTS = "source string, target_share double, max_repeats int, tokens long"


def test_fill_redistributes():
    assert m.fill(100, [1, 1, 2], [1000, 1000, 1000]) == [25, 25, 50]
    assert m.fill(100, [1, 1, 2], [10, 1000, 1000]) == [10, pytest.approx(30), pytest.approx(60)]
    assert m.fill(100, [1, 1], [10, 20]) == [10, 20] and m.fill(0, [1], [5]) == [0] and m.fill(10, [0, 1], [9, 9]) == [0, 9]


def test_shortage_stays_among_siblings_first():
    leaves = [("a", "en", 100), ("a", "de", 10), ("b", "en", 1000)]
    got = {(s, lang): (e, r) for s, lang, e, r in m.plan(leaves, {"a": (0.5, 2), "b": (0.5, 1)}, 200)}
    used = {k: e * n + r for (k, (e, r)), n in zip(sorted(got.items()), (10, 100, 1000))}
    assert sum(v for (s, _), v in used.items() if s == "a") in (99, 100) and used["b", "en"] == 100
    over = m.plan(leaves, {"a": (0.9, 1), "b": (0.1, 1)}, 500)
    assert {(s, lang): e * n + r for (s, lang, e, r), n in zip(over, (10, 100, 1000))} == {("a", "de"): 10, ("a", "en"): 100, ("b", "en"): 390}


def rows():
    out = [(i, f"word{i} " * (i % 7 + 1), ["en", "DE", None, "english"][i % 4], "big", 0, "") for i in range(400)]
    out += [(1000 + i, "some words here", "en", "small", 0, "") for i in range(10)]
    return out + [(2000, None, "en", "big", 0, ""), (2001, "", "en", "small", 0, ""), (2002, "no source", "en", None, 0, ""), (2003, "no weight", "en", "other", 0, "")]


def test_mixture(spark):
    d = spark.createDataFrame(rows(), DOCS)
    w = spark.createDataFrame([("big", 0.6, 1, 0), ("small", 0.3, 3, 0), ("none", 0.1, 2, 0), (None, 0.0, 1, 0)], WEIGHTS)
    got = m.mixture(d, w).collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.copies <= {"big": 1, "small": 3}[r.source] for r in got)
    share = {r.source: r for r in m.shares(d, w).collect()}
    assert share["small"].reached_share == pytest.approx(1 / 3, abs=0.03) and share["none"].tokens == 0 and share["small"].most_copies == 3
    assert sum(r.reached_share for r in share.values()) == pytest.approx(1, abs=1e-5)
    assert sorted(map(tuple, got)) == sorted(map(tuple, m.mixture(d.repartition(7), w).collect()))
    other = {r.doc_id for r in m.mixture(d, w, seed=5).collect()}
    assert other != {r.doc_id for r in got}


def test_prefix_matches_a_sorted_scan(spark):
    from lodestack.session import cut
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows(), DOCS)
    w = spark.createDataFrame([("big", 1.0, 2, 0)], WEIGHTS)
    base = cut(m.sized(d)).filter("source = 'big'")
    total = base.agg(F.sum("n_tokens")).first()[0]
    got = {r.doc_id: r.copies for r in m.mixture(d, w, total=1.4 * total).collect()}
    want = {}
    leaves = [tuple(r) for r in base.groupBy("source", "lang").agg(F.sum("n_tokens")).collect()]
    for s, lang, epochs, rest in m.plan(leaves, {"big": (1.0, 2)}, 1.4 * total):
        run = 0
        for r in base.filter((F.col("source") == s) & (F.col("lang") == lang)).withColumn("o", F.xxhash64(F.lit(m.SEED), F.lit(epochs + 1), "doc_id")).orderBy("o").collect():
            run += r.n_tokens
            n = epochs + (run - r.n_tokens / 2 <= rest)
            if n:
                want[r.doc_id] = n
    assert got == want


def test_empty(spark):
    d, w = spark.createDataFrame([], DOCS), spark.createDataFrame([("big", 1.0, 1, 0)], WEIGHTS)
    assert m.mixture(d, w).count() == 0 and m.shares(d, w).first().reached_share == 0
    assert m.mixture(spark.createDataFrame(rows(), DOCS), w.limit(0)).count() == 0
