"""Upload analysis: every sheet row falls into exactly one bucket, with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.guard import reject_reason
from lodestack.functions.text import strip
from lodestack.functions.urls import domain_of, normalize_url
from lodestack.settings import DEFAULTS, Settings
from lodestack.sources.sheets import URL_VALUE

DUPLICATE = "duplicate URL in this file"


def classify_rows(rows: DataFrame, url_col: str, order_col: str, scope_cols: list[str] | None = None, allow_private: bool = False) -> DataFrame:
    """Adds candidate, normalized_url, bucket (valid, blank, invalid, rejected, duplicate) and reason.

    The first valid row, by order_col, of each normalised URL within the scope is valid, later ones are
    duplicates. The first row is found by a partial aggregation, so a URL typed a million times costs one row
    a task; no window sorts a hot URL's rows in one task. Ties in order_col keep the row with the least values.
    """
    raw = strip(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    rescued = F.when(raw.rlike(URL_VALUE), raw).when(raw.contains(".") & ~raw.contains(" "), F.concat(F.lit("https://"), F.regexp_replace(raw, r"^/+", "")))
    scope = scope_cols or []
    d = rows.withColumn("_raw", raw).withColumn("candidate", F.when(raw != "", rescued))
    d = d.withColumn("_refused", F.when(F.col("candidate").isNotNull(), reject_reason(F.col("candidate"), allow_private)))
    reason = F.when(F.col("_raw") == "", "empty value").when(F.col("candidate").isNull(), "not a URL").otherwise(F.col("_refused"))
    d = d.withColumn("reason", reason).withColumn("normalized_url", F.when(F.col("reason") == "", normalize_url(F.col("candidate"))))
    keys = [*scope, "normalized_url"]
    first = d.filter("reason = ''").groupBy(*keys).agg(F.min(order_col).alias("_first"))
    cond = F.lit(True)
    f = first.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    j = d.join(f, cond & F.col("normalized_url").isNotNull(), "left")
    later = (F.col("reason") == "") & (F.col(order_col) > F.col("_first"))
    bucket = F.when(F.col("_raw") == "", "blank").when(F.col("candidate").isNull(), "invalid").when(F.col("reason") != "", "rejected").when(later, "duplicate").otherwise("valid")
    return j.withColumn("bucket", bucket).withColumn("reason", F.when(later, F.lit(DUPLICATE)).otherwise(F.col("reason"))).drop("_raw", "_refused", "_first", *[f"_k_{k}" for k in keys])


def bucket_counts(classified: DataFrame, scope_cols: list[str]) -> DataFrame:
    """One row for each scope with the five disjoint counts, their total and a one-line summary."""
    n = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    c = classified.groupBy(*scope_cols).agg(*[n(b) for b in ("valid", "blank", "invalid", "duplicate", "rejected")], F.count(F.lit(1)).alias("total"))
    part = lambda b, label: F.when(F.col(b) > 0, F.concat(F.col(b).cast("string"), F.lit(f" {label}")))
    parts = F.concat_ws(", ", F.concat(F.col("valid").cast("string"), F.lit(" valid")), part("duplicate", "duplicate"), part("invalid", "invalid"), part("blank", "empty"), part("rejected", "refused"))
    return c.withColumn("summary", F.concat(F.col("total").cast("string"), F.lit(" row(s): "), parts))


def reason_counts(classified: DataFrame, scope_cols: list[str]) -> DataFrame:
    return classified.filter("reason <> ''").groupBy(*scope_cols, "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def rejected_map(classified: DataFrame, scope_cols: list[str]) -> DataFrame:
    """The reasons of each scope as a map; reasons are few fixed sentences and hosts."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", F.col("n_rows").cast("int").alias("n")))))
    return reason_counts(classified, scope_cols).groupBy(*scope_cols).agg(pairs.alias("rejected_json"))


def pending_rows(classified: DataFrame, batch_id: int) -> DataFrame:
    """The PENDING page rows of a batch, the sheet's cells kept under meta_json."""
    own = {"candidate", "normalized_url", "bucket", "reason"}
    cells = [c for c in classified.columns if c not in own]
    row = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in cells]))
    meta = F.create_map(F.lit("row"), row, F.lit("normalized_url"), F.col("normalized_url"))
    return classified.filter("bucket = 'valid'").select(F.lit(batch_id).cast("long").alias("batch_id"), F.col("candidate").alias("url"), "normalized_url", domain_of(F.col("candidate")).alias("domain"), F.lit("PENDING").alias("crawl_status"), F.lit(0).alias("crawl_depth"), meta.alias("meta_json"))


def check_upload(size_bytes: int, n_urls: int, s: Settings = DEFAULTS) -> None:
    """Refuses uploads beyond the byte and URL limits."""
    if size_bytes > s.max_upload_bytes:
        raise ValueError(f"file of {size_bytes} bytes exceeds the limit of {s.max_upload_bytes}")
    if n_urls > s.max_upload_urls:
        raise ValueError(f"{n_urls} URLs exceed the limit of {s.max_upload_urls}")
