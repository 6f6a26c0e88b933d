"""Batch search: many questions against all vectors in one plan, grouped by page, gated, with people."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from lodestack.functions.vectors import Embedder, embed
from lodestack.settings import DEFAULTS, Settings

#: Queries that are sent to all tasks as they are; more meet the vectors by a shuffle, in blocks of four times this size against blocks of vectors.
QUERY_BLOCK = 4096
#: Questions and vectors that are scored at once, so a task holds one tile of scores however many it reads.
QUERY_TILE, VECTOR_BLOCK = 2048, 1024
#: Scores of a search are equal to so many digits where texts are, wherever in a tile they are summed up.
SCORE_DIGITS = 12


class RunningBest:
    """The k best vectors of each of up to QUERY_TILE questions over all tiles it is shown, ties to the least id."""

    def __init__(self, q: np.ndarray, k: int, round_to: int | None):
        self.q, self.k, self.round_to = q, k, round_to
        self.held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.least, self.last = np.full(len(q), -np.inf), np.full(len(q), np.iinfo(np.int64).max)

    def add(self, own: np.ndarray, m: np.ndarray) -> None:
        """Shows a tile of vectors, their ids ascending."""
        s = self.q @ m.T
        if self.round_to is not None:
            s = np.round(s, self.round_to, out=s)
        if not len(self.held[0]) and s.shape[1] > self.k:
            least = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None]
            above, tied = s > least, s == least
            rows, cols = np.nonzero(above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= self.k - above.sum(axis=1, keepdims=True))))
        else:
            rows, cols = np.nonzero(s >= self.least[:, None])
        ids, scores = own[cols], s[rows, cols]
        near = (scores > self.least[rows]) | (ids < self.last[rows])
        self.new.append((rows[near], ids[near], scores[near]))
        if not len(self.held[0]) or sum(len(x[0]) for x in self.new) > len(self.q) * self.k:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question's row, vector id, score) of the best so far."""
        if self.new:
            rows, ids, scores = (np.concatenate(c) for c in zip(self.held, *self.new))
            order = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep, full = place < self.k, place == self.k - 1
            self.least[rows[full]], self.last[rows[full]] = scores[full], ids[full]
            self.held, self.new = (rows[keep], ids[keep], scores[keep]), []
        return self.held


class BestOfBlocks:
    """(query row, vector id, score) of the k best vectors of all blocks for each query, ties to the least id, in no order."""

    def __init__(self, q: np.ndarray, k: int, round_to: int | None):
        self.parts = [RunningBest(q[i : i + QUERY_TILE], k, round_to) for i in range(0, len(q), QUERY_TILE)]

    def add(self, own: np.ndarray, m: np.ndarray) -> None:
        for i in range(0, len(own), VECTOR_BLOCK):
            by_id = i + np.argsort(own[i : i + VECTOR_BLOCK], kind="stable")
            ids, tile = own[by_id], m[by_id]
            for part in self.parts:
                part.add(ids, tile)

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for n, part in enumerate(self.parts):
            rows, ids, scores = part.merge()
            yield rows + n * QUERY_TILE, ids, scores


def best_of_block(q: np.ndarray, own: np.ndarray, m: np.ndarray, k: int, round_to: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As BestOfBlocks for a single block."""
    best = BestOfBlocks(q, k, round_to)
    best.add(own, m)
    rows, ids, scores = zip(*best.found())
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(n, -1)


def _hits(ids: pa.Array, rows: np.ndarray, own: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(own), pa.array(scores)], names=["query_id", "chunk_id", "score"])


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, round_to: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best vectors of each query by inner product, ties to the least id.

    Every vector is scored and read once: each task's vectors are multiplied with its queries, tile by tile,
    and keeps only its own k best per query, so what is shuffled is bounded by k per query and task, and what a task
    holds by its block of queries, one batch of vectors, one tile of scores and k per query. Up to QUERY_BLOCK queries
    go to the vectors' tasks; more are dealt into blocks that meet blocks of vectors by key. With round_to, scores are rounded before they are
    ranked. Null vectors score nothing.
    """
    kind = "string" if isinstance(queries.schema["query_id"].dataType, StringType) else "long"
    asked = queries.filter("embedding is not null").select(F.col("query_id").cast(kind).alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = vectors.filter("embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = f"query_id {kind}, chunk_id long, score double"
    few = asked.limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows <= QUERY_BLOCK:
        ids, q = few.column(0).combine_chunks(), _matrix(few.column(1), few.num_rows) if few.num_rows else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if q is not None:
                best = BestOfBlocks(q, k, round_to)
                for b in batches:
                    best.add(np.asarray(b.column(0)), _matrix(b.column(1), b.num_rows))
                yield from (_hits(ids, *part) for part in best.found())

        found = base.mapInArrow(run, out)
    else:
        n_q = -(-asked.count() // (4 * QUERY_BLOCK))
        n_v = -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_q)
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        left = base.select(none(kind, "query_id"), "chunk_id", "embedding", F.pmod(F.xxhash64("chunk_id"), F.lit(n_v)).alias("v"), numbers(n_q).alias("b"))
        right = asked.select("query_id", none("long", "chunk_id"), "embedding", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("b"), numbers(n_v).alias("v"))
        # one task for each pair of blocks: it holds the questions, which come first, and reads the vectors in batches
        met = left.unionByName(right).withColumn("pair", (F.col("v") * n_q + F.col("b")).cast("int")).repartitionById(n_q * n_v, F.col("pair")).sortWithinPartitions(F.col("chunk_id").isNotNull())

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asking, best, ids = [], None, None
            for b in batches:
                n = b.column(1).null_count
                if n:
                    head = b.slice(0, n)
                    asking.append((head.column(0), _matrix(head.column(2), n)))
                if n < b.num_rows and asking:
                    if best is None:
                        ids, best = pa.concat_arrays([x for x, _ in asking]), BestOfBlocks(np.concatenate([x for _, x in asking]), k, round_to)
                    tail = b.slice(n)
                    best.add(np.asarray(tail.column(1)), _matrix(tail.column(2), tail.num_rows))
            if best is not None:
                yield from (_hits(ids, *part) for part in best.found())

        found = met.select("query_id", "chunk_id", "embedding").mapInArrow(meet, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= max(1, k))


def threshold_or_best(hits: DataFrame, s: Settings = DEFAULTS, top_k: int | None = None) -> DataFrame:
    """Hits at or above the least score; where a query has none, its first top_k hits with low_confidence set."""
    top_k = top_k or s.search_top_k
    best = F.max("score").over(Window.partitionBy("query_id"))
    judged = hits.withColumn("low_confidence", best < s.search_min_score)
    return judged.filter(F.when(F.col("low_confidence"), F.col("rank") <= top_k).otherwise(F.col("score") >= s.search_min_score))


def group_by_page(hits: DataFrame, s: Settings = DEFAULTS, top_k: int | None = None, key: str = "page_key") -> DataFrame:
    """query_id, page_key, page_rank, score, chunk_id and the page's best chunks, of the top_k pages of each query.

    hits: query_id, chunk_id, score, page_key (and what is carried in `payload`). Equal scores go to the
    least url_id, if there is one, then to the least chunk_id.
    """
    top_k = top_k or s.search_top_k
    extra = [F.col("payload")] if "payload" in hits.columns else []
    tie = [F.col("url_id")] if "url_id" in hits.columns else []
    entry = F.struct((-F.round("score", 4)).alias("neg"), *tie, F.col("chunk_id"), *extra)
    low = [F.max("low_confidence").alias("low_confidence")] if "low_confidence" in hits.columns else []
    # one query's hits are at most overfetch * top_k, so the list is bounded
    pages = hits.groupBy("query_id", key).agg(F.array_sort(F.collect_list(entry)).alias("l"), *low)
    pages = pages.select("query_id", key, (-F.col("l")[0]["neg"]).alias("score"), F.col("l")[0]["chunk_id"].alias("chunk_id"), F.slice("l", 1, 1 + s.context_chunks_per_page).alias("l"), *(["low_confidence"] if low else []))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    m = F.transform("l", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), (-x["neg"]).alias("score"), *([x["payload"].alias("payload")] if extra else [])))
    return pages.withColumn("page_rank", rank).filter(F.col("page_rank") <= top_k).withColumn("matched_chunks", m).drop("l")


def relevance_gate(pages: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds `relevant`: within the set ratio of the query's best page, and at least the least score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return pages.withColumn("relevant", F.col("score") >= F.greatest(best * s.person_relevance_ratio, F.lit(s.search_min_score)))


def attach_people(pages: DataFrame, people: DataFrame) -> DataFrame:
    """Adds `people`, best confidence first, to relevant pages; other pages get an empty list.

    pages needs url_id; people are nested only for pages in the results.
    """
    ids = pages.filter("relevant").select("url_id").distinct()
    card = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("neg"), "id", "name", "title", "company", "confidence")
    nested = people.join(ids, "url_id", "left_semi").groupBy("url_id").agg(F.array_sort(F.collect_list(card)).alias("people"))
    j = pages.join(nested, "url_id", "left")
    none = F.array().cast(nested.schema["people"].dataType)
    return j.withColumn("people", F.when(F.col("relevant"), F.coalesce("people", none)).otherwise(none))


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, pages: DataFrame, people: DataFrame | None = None, s: Settings = DEFAULTS, embedder: Embedder | None = None) -> DataFrame:
    """Ranked pages for each question (query_id, query): score, best chunks, relevance, people, note.

    An empty question gives one row with the note `empty query` and no page; so does an empty index.
    Pages harvested in several batches count once, by normalised URL. Chunk ids without a chunk vanish. Chunks without
    a text column give the numbers of the best chunks alone, and no text is moved.
    """
    asked = queries.select("query_id", F.trim(F.coalesce("query", F.lit(""))).alias("query"))
    q = asked.filter("query <> ''").select("query_id", embed(F.col("query"), embedder).alias("embedding"))
    hits = threshold_or_best(exact_topk(vectors, q, s.search_top_k * s.overfetch, SCORE_DIGITS), s)
    named = chunks.select("chunk_id", "url_id", *([F.struct("heading", "text").alias("payload")] if "text" in chunks.columns else []))
    info = pages.select(F.col("id").alias("url_id"), F.coalesce(F.nullif("normalized_url", F.lit("")), F.col("url")).alias("page_key"), F.col("url"), F.coalesce(F.nullif("title", F.lit("")), F.col("url")).alias("title"))
    placed = hits.join(named, "chunk_id").join(info, "url_id")
    where = placed.select("query_id", "page_key", "chunk_id", "url_id", "url", F.col("title"))
    ranked = relevance_gate(group_by_page(placed, s), s).join(where, ["query_id", "page_key", "chunk_id"])
    if people is not None:
        ranked = attach_people(ranked, people)
    return asked.join(ranked, "query_id", "left").withColumn("note", F.when(F.col("query") == "", "empty query").when(F.col("page_key").isNull(), "nothing indexed matches").when(F.col("low_confidence"), "low confidence").otherwise(F.lit("")))


def rank_people(results: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """query_id, rank, person fields: the cards of each query.

    results: query_id, query, answer, page_rank, people. A (name, title) is shown once, at its best page; people
    whose full name stands in the question or answer come first; at most person_cards of them.
    """
    from lodestack.functions.text import squash

    e = results.select("query_id", "page_rank", squash(F.concat_ws("\n", "query", "answer")).alias("hay"), F.posexplode("people").alias("pos", "p"))
    e = e.withColumn("who", F.lower(F.coalesce("p.name", F.lit("")))).withColumn("what", F.lower(F.coalesce("p.title", F.lit(""))))
    one = e.groupBy("query_id", "who", "what").agg(F.min_by(F.struct("hay", "p", "page_rank", "pos"), F.struct("page_rank", "pos")).alias("x"))
    name = squash(F.col("x.p.name"))
    named = (F.size(F.split(name, " ")) >= 2) & F.contains(F.col("x.hay"), name)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("named"), "x.page_rank", "x.pos"))
    return one.withColumn("named", named).withColumn("rank", order).filter(F.col("rank") <= s.person_cards).select("query_id", "rank", "named", F.col("x.p.name").alias("name"), F.col("x.p.title").alias("title"), F.col("x.p.company").alias("company"), F.col("x.p.confidence").alias("confidence"))
