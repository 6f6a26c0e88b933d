"""Connected components of an undirected edge table, for linkage and line-block operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestack.session import cut_in_loop as cut


#: Up to so many edges (a checked count) are one task's work, some 200 MB; more take distributed rounds.
ONE_TASK = 2_000_000


def components_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least reachable node of each): roots hook on to lesser roots until none is left to."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    ends = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        a, b = root[ends[0]], root[ends[1]]
        apart = a != b
        if not apart.any():
            return nodes, nodes[root]
        ends, a, b = ends[:, apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def _in_one_task(e: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if got:
            nodes, least = components_of(*(np.concatenate(c) for c in zip(*got)))
            for i in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(least[i : i + 100_000])], names=["node", "component"])

    return e.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node id reachable; nodes without edges are absent.

    Alternates large-star and small-star steps, whose edge count never exceeds the input's, until no
    edge changes, however many rounds that takes (each lowers the sum of the nodes' targets, so it ends). Self loops and null ends are ignored, repeated edges count once. Each round is
    checkpointed in the shared folder, so an executor's loss never replays earlier rounds. Few edges of long
    ids need no rounds: one task reads them all.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if all(isinstance(f.dataType, LongType) for f in e.schema) and e.count() <= ONE_TASK:
        return _in_one_task(e)

    def stars(df: DataFrame, large: bool) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = both.join(low, "u")
        if large:
            out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    mark = None
    while True:
        e = cut(stars(stars(e, True), False))
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
