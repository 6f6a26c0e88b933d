"""The chunk and vector index: incremental targets, chunks, vectors, immutable snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.functions.chunking import chunk_text
from lodestack.functions.text import content_hash
from lodestack.functions.vectors import Embedder, HashedBow, embed
from lodestack.settings import DEFAULTS, Settings


def in_scope(pages: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Pages with text or with chunks left from when they had text."""
    d = pages.filter((F.coalesce("text_content", F.lit("")) != "") | (F.coalesce("chunk_count", F.lit(0)) > 0))
    return d if batch_id is None else d.filter(F.col("batch_id") == batch_id)


def needs_work() -> F.Column:
    """Text gone with chunks left, never chunked, or changed since it was indexed."""
    chunks = F.coalesce("chunk_count", F.lit(0))
    return F.when(F.coalesce("text_content", F.lit("")) == "", chunks > 0).otherwise((chunks == 0) | ~F.coalesce("indexed_hash", F.lit("")).eqNullSafe(F.coalesce("content_hash", F.lit(""))))


def targets(pages: DataFrame, batch_id: int | None = None, rebuild: bool = False) -> DataFrame:
    d = in_scope(pages, batch_id)
    return d if rebuild else d.filter(needs_work())


def make_chunks(pages: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """chunk_id, url_id, ordinal, text, char_start, char_end, heading; the id is a hash of page and ordinal."""
    c = pages.filter(F.coalesce("text_content", F.lit("")) != "").select(F.col("id").alias("url_id"), F.explode(chunk_text(F.col("text_content"), s)).alias("c"))
    return c.select(F.xxhash64("url_id", "c.ordinal").alias("chunk_id"), "url_id", "c.ordinal", "c.text", "c.char_start", "c.char_end", "c.heading")


def make_vectors(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    return chunks.select("chunk_id", embed(F.col("text"), embedder).alias("embedding"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows that are not replaced, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def reindex(pages: DataFrame, chunks: DataFrame, vectors: DataFrame, batch_id: int | None = None, rebuild: bool = False, s: Settings = DEFAULTS, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, chunks, vectors) after an incremental pass; pages outside its scope keep theirs.

    Work is proportional to what changed: only targets are chunked and embedded, the rest is an anti join.
    """
    todo = targets(pages, batch_id, rebuild)
    fresh = make_chunks(todo, s)
    touched = todo.select(F.col("id").alias("url_id"))
    stale = chunks.join(touched, "url_id", "left_semi").select("chunk_id")
    new_chunks = remove(chunks, touched, "url_id").unionByName(fresh.select(*chunks.columns) if set(chunks.columns) <= set(fresh.columns) else fresh, allowMissingColumns=True)
    new_vectors = upsert(remove(vectors, stale, "chunk_id"), make_vectors(fresh, embedder), "chunk_id")
    n = fresh.groupBy("url_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    t = touched.join(n, "url_id", "left").select(F.col("url_id").alias("_id"), F.coalesce("_n", F.lit(0)).alias("_n"))
    j = pages.join(t, pages.id == t["_id"], "left")
    done = F.col("_id").isNotNull()
    new = {"chunk_count": F.col("_n"), "indexed_hash": F.coalesce("content_hash", content_hash(F.col("text_content")))}
    return j.select(*[F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in pages.columns]), new_chunks, new_vectors


def save_snapshot(vectors: DataFrame, root: str, embedder: Embedder | None = None, version: str | None = None) -> DataFrame:
    """Writes the vectors under a new version, then the one-row index_meta that makes it current.

    A reader never sees half a snapshot: the folder is complete before the row names it. A corrupt or missing
    index_meta means an empty index.
    """
    e = embedder or HashedBow()
    version = version or uuid.uuid4().hex
    path = f"{root}/snapshot={version}"
    vectors.write.mode("errorifexists").parquet(path)
    spark = vectors.sparkSession
    n = spark.read.parquet(path).count()
    meta = spark.createDataFrame([(1, version, e.dim, e.name, n, None, path)], schemas.schema("index_meta")).withColumn("built_at", F.current_timestamp())
    meta.coalesce(1).write.mode("overwrite").parquet(f"{root}/index_meta")
    return spark.read.parquet(f"{root}/index_meta")


def load_snapshot(spark: SparkSession, root: str) -> DataFrame:
    try:
        meta = spark.read.parquet(f"{root}/index_meta").first()
        return spark.read.parquet(meta.path) if meta else schemas.empty(spark, "vectors")
    except Exception as e:  # the reader's errors differ by file system
        if "PATH_NOT_FOUND" in str(e) or "CANNOT_READ" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "FAILED_READ_FILE" in str(e):
            return schemas.empty(spark, "vectors")
        raise


def describe(vectors: DataFrame, version: str = "", path: str = "", model: str = DEFAULTS.embedding_model) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim")).select(F.lit("flat").alias("type"), F.lit("inner_product").alias("metric"), "dim", "vectors", F.lit(model).alias("model"), F.lit(version).alias("version"), F.lit(path).alias("path"), F.lit(path != "").alias("persisted"))


def integrity(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunk_id, problem of chunks without a vector and vectors without a chunk; empty when the index is whole."""
    a = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit("no vector").alias("problem"))
    return a.unionByName(vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit("no chunk").alias("problem")))
