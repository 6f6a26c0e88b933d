"""Listings, counts and progress over the stored tables. Predicates are native, so they reach the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import status as st

#: Orderings of the page listing; the id decides ties (fixed values).
ORDERS = {
    "id": lambda: [F.asc("id")],
    "-id": lambda: [F.desc("id")],
    "http_status": lambda: [F.asc("http_status"), F.asc("id")],
    "-http_status": lambda: [F.desc("http_status"), F.asc("id")],
    "fetched_at": lambda: [F.asc("fetched_at"), F.asc("id")],
    "-fetched_at": lambda: [F.desc("fetched_at"), F.asc("id")],
    "url": lambda: [F.asc("url"), F.asc("id")],
    "-url": lambda: [F.desc("url"), F.asc("id")],
}
MAX_PAGE_SIZE = 200
HEAVY = ("raw_html", "text_content")


def _like(c: str, q: str) -> Column:
    return F.ilike(F.col(c), F.lit(f"%{q}%"))


def filter_pages(pages: DataFrame, batch: int | None = None, http_status: int | None = None, has_error: bool | None = None, q: str | None = None, status: str | None = None) -> DataFrame:
    """All conditions given hold; `%` and `_` in q are wildcards; an unknown status is no condition."""
    d = pages
    if batch is not None:
        d = d.filter(F.col("batch_id") == batch)
    if http_status is not None:
        d = d.filter(F.col("http_status") == http_status)
    if has_error is not None:
        d = d.filter((F.col("error") != "") if has_error else (F.col("error") == ""))
    if q:
        d = d.filter(_like("url", q) | _like("title", q))
    if status in st.LABELS:
        d = d.filter(F.col("crawl_status") == status)
    return d


def page_listing(pages: DataFrame, ordering: str = "id", page: int = 1, page_size: int = 25, include_html: bool = False, include_content: bool = False, **conditions) -> DataFrame:
    """One listing page: the lengths of the heavy texts always, the texts themselves only on request."""
    size = max(1, min(page_size, MAX_PAGE_SIZE))
    d = filter_pages(pages, **conditions).orderBy(*ORDERS.get(ordering, ORDERS["id"])())
    d = d.offset((max(page, 1) - 1) * size).limit(size)
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    shown = [c for c in d.columns if c not in HEAVY]
    return d.select(
        *shown,
        length("raw_html").alias("html_length"),
        length("text_content").alias("text_length"),
        *([F.col("raw_html")] if include_html else []),
        *([F.col("text_content")] if include_content else []),
        st.status_label(F.col("crawl_status")).alias("status_label"),
        st.failure_line(F.col("error"), F.col("http_status")).alias("failure_reason"),
    )


def page_count(pages: DataFrame, page_size: int = 25, **conditions) -> DataFrame:
    n = F.count(F.lit(1))
    return filter_pages(pages, **conditions).agg(n.alias("count"), F.expr(f"(count(1) + {page_size - 1}) div {page_size}").alias("pages"))


def people_listing(people: DataFrame, pages: DataFrame, q: str | None = None, company: str | None = None, batch: int | None = None, limit: int = 100) -> DataFrame:
    """People with their page's address, by name; q is looked for in name, title, company and bio."""
    d = people
    if q:
        d = d.filter(_like("name", q) | _like("title", q) | _like("company", q) | _like("bio", q))
    if company:
        d = d.filter(_like("company", company))
    if batch is not None:
        d = d.filter(F.col("batch_id") == batch)
    j = d.join(pages.select(F.col("id").alias("url_id"), F.col("url").alias("source_url")), "url_id")
    return j.orderBy("name", "id").limit(min(limit, 500))


def crawl_counts(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total and the five shown states; a null state is pending, skipped and processing count only in total."""
    s = F.lower(F.coalesce("crawl_status", F.lit("PENDING")))
    aggs = [F.count(F.lit(1)).alias("total"), *[F.count_if(s == k).alias(k) for k in ("success", "partial", "blocked", "failed", "pending")]]
    return pages.groupBy(*by).agg(*aggs) if by else pages.agg(*aggs)


def table_counts(**tables: DataFrame) -> DataFrame:
    """name, n_rows of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def percent(processed: Column, total: Column, status: Column) -> Column:
    """Whole percent done, at most 100; a job without a total is at 100 once it succeeded, else at 0."""
    t = F.coalesce(total, F.lit(0))
    return F.when(t == 0, F.when(status == "success", 100).otherwise(0)).otherwise(F.least(F.lit(100), F.floor(F.coalesce(processed, F.lit(0)) / t * 100))).cast("int")


def job_listing(jobs: DataFrame, limit: int = 50, active_only: bool = False) -> DataFrame:
    d = jobs.filter(F.col("status").isin("running", "queued")) if active_only else jobs
    return d.withColumn("percent", percent(F.col("processed"), F.col("total"), F.col("status"))).orderBy(F.desc("id")).limit(limit)


def fail_orphans(jobs: DataFrame, message: str = "interrupted by a restart") -> DataFrame:
    """Jobs left running or queued by a stopped process become failed."""
    lost = F.col("status").isin("running", "queued")
    return jobs.withColumns({"status": F.when(lost, "failed").otherwise(F.col("status")), "message": F.when(lost, message).otherwise(F.col("message"))})


def finish_job(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs with counters from item outcomes (job_id, ok): success is reported with its failed count."""
    n = outcomes.groupBy(F.col("job_id").alias("_j")).agg(F.count(F.lit(1)).cast("int").alias("_n"), F.count_if("ok").cast("int").alias("_ok"))
    j = jobs.join(n, jobs.id == n["_j"], "left")
    hit = F.col("_j").isNotNull()
    new = {"processed": F.col("_n"), "succeeded": F.col("_ok"), "failed": F.col("_n") - F.col("_ok"), "status": F.lit("success")}
    return j.select(*[F.when(hit, new[c]).otherwise(jobs[c]).alias(c) if c in new else jobs[c] for c in jobs.columns])


def batch_listing(batches: DataFrame, limit: int = 50) -> DataFrame:
    return batches.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(limit)


def recent_searches(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(limit)


def one(df: DataFrame, row_id: int) -> DataFrame:
    """The row with this id, if there is one."""
    return df.filter(F.col("id") == row_id).limit(1)


def delete_batch(batch_id: int, pages: DataFrame, chunks: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, chunks, people) without a batch: pages, their chunks and people go; other people forget the batch."""
    gone = pages.filter(F.col("batch_id") == batch_id).select(F.col("id").alias("url_id"))
    kept = people.join(gone, "url_id", "left_anti")
    return pages.filter(~F.col("batch_id").eqNullSafe(F.lit(batch_id))), chunks.join(gone, "url_id", "left_anti"), kept.withColumn("batch_id", F.when(F.col("batch_id") != batch_id, F.col("batch_id")))
