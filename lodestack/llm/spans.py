"""Problem 8: long exact spans shared between records.

Method: sliding spans joined globally. Every text is cut at content-defined points; the run of RUN
characters that starts at each cut is hashed, runs are joined globally, and what repeats is grown to
the wanted length. Sentence ends alone cannot serve as cuts here: a shared passage may begin and end
inside sentences, so a run of whole sentences inside it need not exist. The cuts are the positions
whose run hash is the smallest of some CUT_WINDOW consecutive positions, which puts at least one whole
common run into every common span of RUN + CUT_WINDOW - 1 = 200 characters. `shared_clean` then works
on sentences: those covered by spans that an earlier document holds are removed, the spans being exact.

Defined results: null texts and texts shorter than the span have no links; repeated doc_ids never link
to themselves; equal texts of sufficient length are linked as one class and only expanded for the
pair listing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import cut

MIN_SPAN = 200
RUN = 104
CUT_WINDOW = MIN_SPAN - RUN + 1
#: Windows of a repeated run are compared in steps of STEP characters, the rest by their flanks.
STEP = 16
WINDOW = MIN_SPAN - STEP + 1
BLOCK_CHARS = 3_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Roller:
    """Hashes of all equally long windows of a code point array, from one prefix sum."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INV, n)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, starts: np.ndarray | None, length: int) -> np.ndarray:
        if starts is None:
            d = (prefix[length:] - prefix[:-length]) * self.down[: len(prefix) - length]
        else:
            d = (prefix[starts + length] - prefix[starts]) * self.down[starts]
        return _mix(d)


def _sliding(x: np.ndarray, w: int, best: np.ufunc, fill: np.uint64) -> np.ndarray:
    """best over x[i:i+w] for every i with a full window."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, fill, dtype=x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    fore = best.accumulate(y, axis=1).ravel()
    back = best.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - w + 1], fore[w - 1 : n])


def cut_points(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cuts in the joined code points of many texts, and their run hashes."""
    n = len(codes) - RUN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = roller.windows(roller.prefix(codes), None, RUN)
    whole = np.zeros(n + RUN, dtype=np.int8)
    ok = ends - starts >= RUN
    np.add.at(whole, starts[ok], 1)
    np.add.at(whole, ends[ok] - RUN + 1, -1)
    inside = np.cumsum(whole[:n], dtype=np.int64) > 0
    h = np.where(inside, h, top)
    pad = CUT_WINDOW - 1
    padded = np.concatenate((np.full(pad, top), h, np.full(pad, top)))
    least = _sliding(padded, CUT_WINDOW, np.minimum, top)
    chosen = _sliding(least, CUT_WINDOW, np.maximum, np.uint64(0)) == h
    at = np.flatnonzero(chosen & inside)
    return at, h[at]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    return codes, ends


def _sliced(batch: pa.RecordBatch, limit: int, text_at: int = 1) -> Iterator[pa.RecordBatch]:
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0))
    start, n = 0, len(lengths)
    while start < n:
        take = max(1, int(np.searchsorted(np.cumsum(lengths[start:]), limit, side="right")))
        yield batch.slice(start, take)
        start += take


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roller = Roller()
    for whole in batches:
        for batch in _sliced(whole, BLOCK_CHARS):
            codes, ends = _joined(batch.column(1).to_pylist())
            starts = np.concatenate(([0], ends[:-1]))
            at, h = cut_points(codes, starts, ends, roller)
            row = np.searchsorted(ends, at, side="right")
            ids = np.asarray(batch.column(0))
            order = np.lexsort((h, row))
            first = np.ones(len(h), dtype=bool)
            first[order[1:]] = (np.diff(row[order]) != 0) | (h[order[1:]] != h[order[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[row]), pa.array((at - starts[row]).astype(np.int32)), pa.array(first)], names=["h", "doc_id", "pos", "first"])


def _windows(batches: Iterator[pa.RecordBatch], all_places: bool) -> Iterator[pa.RecordBatch]:
    """For each repeated run the WINDOW-long windows that hold it, with the flanks that decide the rest.

    Without all_places a window that a text repeats with the same flanks (as periodic texts do) comes once.
    """
    roller = Roller()
    offsets = np.arange(0, MIN_SPAN - RUN + 1, STEP, dtype=np.int64)
    flank = STEP - 1
    for whole in batches:
        for batch in _sliced(whole, BLOCK_CHARS):
            out: list[tuple[list, list, list, list, list]] = []
            for doc, text, pos in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                begin = np.unique((np.asarray(pos, dtype=np.int64)[:, None] - offsets).ravel())
                begin = begin[(begin >= 0) & (begin + WINDOW <= len(text))]
                if not len(begin):
                    continue
                codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                keys = roller.windows(roller.prefix(codes), begin, WINDOW).view(np.int64)
                b, ks = begin.tolist(), keys.tolist()
                lf, rf = [text[max(0, i - flank) : i] for i in b], [text[i + WINDOW : i + WINDOW + flank] for i in b]
                if not all_places:
                    once = {(k, x, y): i for i, k, x, y in zip(b, ks, lf, rf)}
                    b = list(once.values())
                    ks, lf, rf = ([t[j] for t in once] for j in range(3))
                out.append((ks, [doc] * len(b), b, lf, rf))
            if out:
                cols = [[x for part in out for x in part[i]] for i in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=["k", "doc_id", "at", "lf", "rf"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") >= MIN_SPAN))


def copy_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, rep) of every document whose long-enough text occurs under more than one id; rep is the least id."""
    keyed = _texts(docs).select("doc_id", F.unhex(F.md5("text")).alias("m"))
    first = keyed.groupBy("m").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last").select("m", "rep")
    return keyed.join(first, "m").select("doc_id", "rep").distinct()


def repeated_windows(docs: DataFrame, copies: DataFrame, all_places: bool) -> DataFrame:
    """Windows around runs that occur in more than one text class: k, doc_id (the class's rep), at, lf, rf."""
    texts = _texts(docs)
    runs = texts.mapInArrow(_runs, "h long, doc_id long, pos int, first boolean")
    # counting each text's runs once moves half of what their holders would
    shared = runs.filter("first").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    again = lambda df: df.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h")
    hits = runs.drop("first").join(shared, "h").join(copies.filter("doc_id > rep").select("doc_id"), "doc_id", "left_anti")
    hits = cut(hits)
    hits = hits.join(again(hits), "h")
    places = hits.groupBy("doc_id").agg(F.collect_set("pos").alias("pos"))
    held = texts.join(places, "doc_id").select("doc_id", "text", "pos").mapInArrow(lambda batches: _windows(batches, all_places), "k long, doc_id long, at int, lf string, rf string")
    return held


def _flanks_agree() -> F.Column:
    """True where the characters beside two equal windows make the common span MIN_SPAN long."""
    out = F.lit(False)
    for i in range(STEP):
        left = F.lit(True) if i == 0 else (F.expr(f"length(lf_a) >= {i} and length(lf_b) >= {i} and right(lf_a, {i}) = right(lf_b, {i})"))
        j = STEP - 1 - i
        right = F.lit(True) if j == 0 else (F.expr(f"length(rf_a) >= {j} and length(rf_b) >= {j} and left(rf_a, {j}) = left(rf_b, {j})"))
        out = out | (left & right)
    return out


def shared_pairs(docs: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b for all documents with a common run of MIN_SPAN characters."""
    copies = cut(copy_classes(docs))
    w = repeated_windows(docs, copies, False)
    side = lambda s: w.select("k", F.col("doc_id").alias(f"doc_id_{s}"), F.col("lf").alias(f"lf_{s}"), F.col("rf").alias(f"rf_{s}"))
    links = side("a").join(side("b"), "k").filter("doc_id_a < doc_id_b").filter(_flanks_agree()).select("doc_id_a", "doc_id_b").distinct()
    grow = lambda df, s: (
        df.join(copies.select(F.col("rep").alias(f"doc_id_{s}"), F.col("doc_id").alias("m")), f"doc_id_{s}", "left")
        .withColumn(f"doc_id_{s}", F.coalesce("m", f"doc_id_{s}"))
        .drop("m")
    )
    across = grow(grow(links, "a"), "b").select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b"))
    within = copies.select("rep", F.col("doc_id").alias("doc_id_a")).join(copies.select("rep", F.col("doc_id").alias("doc_id_b")), "rep").filter("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    return across.unionByName(within)


def _reach(w: DataFrame) -> DataFrame:
    """k, lf, rf of windows inside a common span of MIN_SPAN: first (least holder), and by how many characters
    the first and last such span start before the window: lo, hi of any other holder, past_lo, past_hi of an
    earlier holder than first. Equal flanks reach as far as they go; only keys with several flanks are tried
    in steps, as groups of equal spans, so no pairs are formed.
    """
    flank = STEP - 1
    lo, hi = F.greatest(F.lit(flank) - F.length("rf"), F.lit(0)), F.length("lf")
    seen = w.groupBy("k", "lf", "rf").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    several = seen.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    steps = seen.join(several, "k").filter(lo <= hi).withColumn("i", F.explode(F.sequence(lo, hi)))
    steps = steps.withColumn("l", F.expr("right(lf, i)")).withColumn("r", F.expr(f"left(rf, {flank} - i)"))
    spans = steps.groupBy("k", "i", "l", "r").agg(F.min("first").alias("a"), F.max("last").alias("b")).filter("a < b")
    past = F.when(F.col("a") < F.col("first"), F.col("i"))
    reach = steps.join(spans, ["k", "i", "l", "r"]).groupBy("k", "lf", "rf").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.min(past).alias("past_lo"), F.max(past).alias("past_hi"))
    whole = (F.col("first") < F.col("last")) & (lo <= hi)
    got = seen.join(reach, ["k", "lf", "rf"], "left").filter(F.col("lo").isNotNull() | whole)
    return got.select("k", "lf", "rf", "first", F.coalesce("lo", lo).alias("lo"), F.coalesce("hi", hi).alias("hi"), "past_lo", "past_hi")


def shared_intervals(docs: DataFrame) -> DataFrame:
    """doc_id, rep, is_copy, spans and later (arrays of (at, to), sorted) per document: what any other document, and what an earlier one, holds in runs of MIN_SPAN.

    Linear in the number of repeated windows: no pairs are formed. The union of the spans is exact.
    """
    copies = cut(copy_classes(docs))
    w = cut(repeated_windows(docs, copies, True))  # three consumers follow
    span = lambda lo, hi: F.struct((F.col("at") - hi).alias("at"), (F.col("at") - lo + MIN_SPAN).alias("to"))
    past = F.when(F.col("doc_id") > F.col("first"), span(F.greatest(F.lit(STEP - 1) - F.length("rf"), F.lit(0)), F.length("lf"))).when(F.col("past_lo").isNotNull(), span(F.col("past_lo"), F.col("past_hi")))
    held = w.join(_reach(w), ["k", "lf", "rf"]).select("doc_id", span(F.col("lo"), F.col("hi")).alias("span"), past.alias("past"))
    per = held.groupBy("doc_id").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("past")).alias("later"))
    return copies.select(F.col("doc_id"), F.col("rep")).join(per.withColumnRenamed("doc_id", "rep"), "rep", "full_outer").select(F.coalesce("doc_id", "rep").alias("doc_id"), "rep", F.col("doc_id").isNotNull().alias("is_copy"), "spans", "later")


def _covered(spans: F.Column) -> F.Column:
    """Characters under the union of sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    more = lambda s, x: F.struct((s.n + F.greatest(x.to - F.greatest(x.at, s.to), F.lit(0))).alias("n"), F.greatest(x.to, s.to).alias("to"))
    return F.coalesce(F.aggregate(spans, start, more, lambda s: s.n), F.lit(0))


def shared_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_part for every row of documents."""
    per = shared_intervals(docs).select("doc_id", "is_copy", _covered(F.col("spans")).alias("n"))
    size = F.coalesce(F.length("text"), F.lit(0))
    return (
        docs.select("doc_id", size.alias("n_chars"))
        .join(per, "doc_id", "left")
        .select("doc_id", "n_chars", F.when(F.coalesce("is_copy", F.lit(False)), F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0))).alias("shared_chars"))
        .withColumn("shared_part", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 4)).otherwise(F.lit(0.0)))
    )


#: End of a sentence (fixed value).
SENTENCE_END = r"(?<=[.!?…。！？])\s+|\n+"


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    end = re.compile(SENTENCE_END)
    for batch in batches:
        ids, texts, drops = [], [], []
        for doc, text, later, whole in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if text is None or whole:
                kept, n = (text, 0) if text is None else ("", len(text))
            elif not later:
                kept, n = text, 0
            else:
                cover = np.zeros(len(text) + 1, dtype=np.int32)
                np.add.at(cover, [x["at"] for x in later], 1)
                np.add.at(cover, [x["to"] for x in later], -1)
                bare = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) == 0)))
                parts, start = [], 0
                for m in [*end.finditer(text), None]:
                    stop = m.start() if m else len(text)
                    if bare[stop] > bare[start] or stop == start:
                        parts.append(text[start : m.end() if m else stop])
                    start = m.end() if m else stop
                kept = "".join(parts)
                n = len(text) - len(kept)
            ids.append(doc)
            texts.append(kept)
            drops.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(drops, pa.int32())], names=["doc_id", "clean_text", "removed_chars"])


def shared_clean(docs: DataFrame) -> DataFrame:
    """Every document without the sentences that a non-first repeated span covers; a later copy becomes empty."""
    per = shared_intervals(docs).select("doc_id", "later", (F.col("is_copy") & (F.col("doc_id") > F.col("rep"))).alias("whole"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(per, "doc_id", "left").select("doc_id", "text", "later", F.coalesce("whole", F.lit(False)).alias("whole")).mapInArrow(_cleaned, "doc_id long, clean_text string, removed_chars int")
