"""The append-only search log."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST_QUERY = 2000


def log_rows(queries: DataFrame, results: DataFrame, top_k: int, latency_ms: int = 0, llm_used: bool = False, provider: str = "") -> DataFrame:
    """One log row for each question, with the number of its results."""
    n = results.filter("page_rank is not null").groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("result_count"))
    return queries.join(n, "query_id", "left").select(F.col("query_id").alias("id"), F.substring("query", 1, LONGEST_QUERY).alias("query"), F.lit(top_k).alias("top_k"), F.coalesce("result_count", F.lit(0)).alias("result_count"), F.lit(latency_ms).alias("latency_ms"), F.lit(llm_used).alias("llm_used"), F.lit(provider).alias("provider"), F.current_timestamp().alias("created_at"))


def append(rows: DataFrame, path: str) -> bool:
    """Appends to the log; a failure to log never fails a search."""
    try:
        rows.write.mode("append").parquet(path)
        return True
    except Exception:
        logging.getLogger(__name__).warning("search log could not be written", exc_info=True)
        return False


def deduplicated(log: DataFrame) -> DataFrame:
    """The log without rows that were delivered twice: the latest of each id."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), "created_at").alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])
