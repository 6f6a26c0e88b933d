"""Structured Streaming forms of the incremental passes: micro-batches of pages into the index, an append-only log."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.operators.index import make_chunks, make_vectors
from lodestack.settings import DEFAULTS, Settings


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schemas.schema("harvested_urls")).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def index_stream(pages: DataFrame, root: str, checkpoint: str, s: Settings = DEFAULTS):
    """A query that chunks and embeds each micro-batch of pages.

    A batch is written under its number, so a replayed batch overwrites itself and nothing is indexed twice.
    Several versions of a page in one batch are reduced to the latest before they are chunked.
    """

    def sink(batch: DataFrame, number: int) -> None:
        rest = [c for c in ("text_content", "content_hash") if c in batch.columns]
        one = batch.groupBy("id").agg(F.max_by(F.struct(*rest), F.coalesce("updated_at", "fetched_at", F.timestamp_seconds(F.lit(0)))).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])
        chunks = make_chunks(one, s).withColumn("batch_no", F.lit(number).cast("long"))
        out = os.path.join(root, f"chunks/batch_no={number}")
        chunks.drop("batch_no").write.mode("overwrite").parquet(out)
        back = batch.sparkSession.read.parquet(out)
        make_vectors(back).write.mode("overwrite").parquet(os.path.join(root, f"vectors/batch_no={number}"))
        one.select("id", "content_hash").write.mode("overwrite").parquet(os.path.join(root, f"pages/batch_no={number}"))

    return pages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of each page's latest batch; a page that lost its text has none."""
    seen = spark.read.parquet(os.path.join(root, "pages")).groupBy(F.col("id").alias("url_id")).agg(F.max("batch_no").alias("batch_no"))
    return spark.read.parquet(os.path.join(root, "chunks")).join(seen, ["url_id", "batch_no"])


def log_stream(searches: DataFrame, path: str, checkpoint: str):
    """Appends a stream of search rows to the log."""
    return searches.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def progress(query) -> dict:
    """What a polling client needs of a running query."""
    p = query.lastProgress or {}
    return {"batch": p.get("batchId"), "rows": p.get("numInputRows"), "active": query.isActive}
