"""Problem 7: mixing sources to target weights.

Method: hierarchical budgeting. The token budget goes down a tree (source, then language) by weight; a
node that cannot use its part, even with its records repeated as often as allowed, leaves the shortage
to its siblings, and only what no sibling can take goes up to the node's ancestors. Languages weigh their
tokens to the power LANG_POWER, so a small one runs short and its siblings fill in, before its source does. Each leaf then takes
whole seeded epochs of its records and a prefix, by tokens, of one more epoch.

The total defaults to the largest at which no source that has documents falls short of its share. Sizes
are tokens of a public tokenizer. Records without a source, or of a source without a weight, are not
mixed; records without tokens add nothing and are left out. A prefix takes the record that
crosses its budget if more than half of it lies within. Null or negative weights count as 0, null repeats as 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.tokens import DEFAULT_VOCAB, encode_corpus
from lodestack.session import cut

SEED = 17
#: A language weighs its tokens to this power within its source, so that small languages are lifted and run short first.
LANG_POWER = 0.7
#: Ranges of the seeded order for which sums are kept; a leaf's cut falls into one of them.
RANGES = 4096


def sized(docs: DataFrame, vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """doc_id, source, lang (a two-letter code or `und`), n_tokens of every record with tokens."""
    lang = F.lower(F.trim("lang"))
    keyed = docs.select(F.struct("doc_id", "source", F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("und").alias("lang")).alias("k"), F.col("text"))
    keyed = keyed.filter("k.source is not null")
    counted = encode_corpus(keyed, "k", "text", vocab_path, counts_only=True)
    return counted.filter("n_tokens > 0").select("k.doc_id", "k.source", "k.lang", "n_tokens")


def fill(budget: float, weights: list[float], rooms: list[float]) -> list[float]:
    """Splits a budget by weight; what a member has no room for goes to the others, again by weight."""
    got = [0.0] * len(weights)
    open_ = [i for i, (w, r) in enumerate(zip(weights, rooms)) if w > 0 and r > 0]
    while open_ and budget > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rooms[i] - got[i] <= budget * weights[i] / total + 1e-9]
        if not full:
            for i in open_:
                got[i] += budget * weights[i] / total
            return got
        for i in full:
            budget -= rooms[i] - got[i]
            got[i] = rooms[i]
        open_ = [i for i in open_ if i not in full]
    return got


def plan(leaves: list[tuple[str, str, int]], weights: dict[str, tuple[float, int]], total: float | None = None) -> list[tuple[str, str, int, int]]:
    """(source, lang, whole epochs, tokens of the prefix) for leaves (source, lang, tokens)."""
    tree: dict[str, list[tuple[str, int]]] = {}
    for source, lang, n in leaves:
        if source in weights and n:
            tree.setdefault(source, []).append((lang, int(n)))
    names = sorted(tree)
    share = [weights[s][0] for s in names]
    rooms = [float(weights[s][1] * sum(n for _, n in tree[s])) for s in names]
    live = sum(share)
    if total is None:
        total = min((r * live / w for r, w in zip(rooms, share) if w > 0), default=0.0)
    out = []
    for s, budget in zip(names, fill(total, share, rooms)):
        kids = sorted(tree[s])
        times = weights[s][1]
        for (lang, n), b in zip(kids, fill(budget, [float(n) ** LANG_POWER for _, n in kids], [float(times * n) for _, n in kids])):
            epochs = min(int(b // n), times)
            out.append((s, lang, epochs, 0 if epochs == times else int(b - epochs * n)))
    return out


def mixture(docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = SEED, vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """doc_id, source, lang, n_tokens, copies of every record used.

    Only leaf totals reach the driver: at most one row for each weighted source and two-letter code.
    A leaf's prefix is found from sums over ranges of the seeded order; records are ranked one by one
    only inside the range where the prefix ends, so no leaf is sorted or held as a whole.
    """
    spark = docs.sparkSession
    w = {r[0]: (max(float(r[1] or 0), 0.0), int(r[2] if r[2] is not None else 1)) for r in weights.filter("source is not null").select("source", "target_share", "max_repeats").collect()}
    known = weights.filter("source is not null").select("source").distinct()
    base = cut(sized(docs, vocab_path).join(known, "source", "left_semi"))
    leaves = [tuple(r) for r in base.groupBy("source", "lang").agg(F.sum("n_tokens")).collect()]
    todo = spark.createDataFrame(plan(leaves, w, total), "source string, lang string, epochs int, rest long")
    # the epoch's order of a record: a seeded hash; its range is the leading part of the hash
    order = F.xxhash64(F.lit(seed), F.col("epochs") + 1, F.col("doc_id"))
    rows = base.join(F.broadcast(todo), ["source", "lang"]).withColumn("o", order).withColumn("range", F.floor((F.col("o").cast("double") / 2.0**64 + 0.5) * RANGES).cast("int"))
    sums = rows.groupBy("source", "lang", "rest", "range").agg(F.sum("n_tokens").alias("s"))
    upto = F.sum("s").over(Window.partitionBy("source", "lang").orderBy("range"))
    edge = sums.withColumn("to", upto).filter("to > rest").groupBy("source", "lang").agg(F.min(F.struct("range", (F.col("to") - F.col("s")).alias("base"))).alias("e")).select("source", "lang", F.col("e.range").alias("edge"), F.col("e.base").alias("base"))
    # bound: one row for each leaf
    rows = rows.join(F.broadcast(edge), ["source", "lang"], "left")
    inside = rows.filter("range = edge")
    run = F.sum("n_tokens").over(Window.partitionBy("source", "lang").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("copies", F.col("epochs") + (F.col("base") + run - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    outside = rows.filter("edge is null or range <> edge").withColumn("copies", F.col("epochs") + F.expr("(edge is null or range < edge) and rest > 0").cast("int"))
    return outside.unionByName(inside).filter("copies > 0").select("doc_id", "source", "lang", "n_tokens", "copies")


def shares(docs: DataFrame, weights: DataFrame, **options) -> DataFrame:
    """source, target_share, documents, tokens, reached_share, most_copies of every weighted source."""
    used = mixture(docs, weights, **options).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    all_ = weights.filter("source is not null").select("source", "target_share").join(used, "source", "left").fillna(0, ["documents", "tokens", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy())
    return all_.select("source", "target_share", "documents", "tokens", F.when(total > 0, F.round(F.col("tokens") / total, 6)).otherwise(F.lit(0.0)).alias("reached_share"), "most_copies")
