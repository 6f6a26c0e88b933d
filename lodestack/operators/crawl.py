"""Link discovery: breadth-first over depths, with a seen set kept as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.guard import reject_reason
from lodestack.functions.html import anchors
from lodestack.functions.links import is_crawlable, link_score
from lodestack.functions.urls import dedup_key
from lodestack.session import cut
from lodestack.settings import DEFAULTS, Settings


def page_links(pages: DataFrame, same_domain_only: bool = True, limit: int = 200) -> DataFrame:
    """page_id, page_url, url, key, score, matched, rank: the crawlable links of each page, best first.

    The first anchor of a link on a page gives its text. Ranking is within a page, whose links are bounded
    by its HTML. Pages without HTML have no links.
    """
    base = pages.select(F.col("id").alias("page_id"), F.col("url").alias("page_url"), F.col("raw_html").alias("h")).filter("h <> ''")
    a = base.select("page_id", "page_url", F.explode(anchors(F.col("h"), F.col("page_url"))).alias("a"))
    a = a.filter(is_crawlable(F.col("a.href"), F.col("page_url"), same_domain_only)).select("page_id", "page_url", F.col("a.href").alias("url"), F.col("a.text").alias("text"), F.col("a.pos").alias("pos"), dedup_key(F.col("a.href")).alias("key"))
    a = a.filter(F.col("key") != dedup_key(F.col("page_url")))
    one = a.groupBy("page_id", "key").agg(F.min_by(F.struct("page_url", "url", "text"), "pos").alias("l"))
    scored = one.select("page_id", F.col("l.page_url").alias("page_url"), F.col("l.url").alias("url"), "key", link_score(F.col("l.url"), F.col("l.text")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("s.score"), "url"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).select("page_id", "page_url", "url", "key", F.col("s.score").alias("score"), F.col("s.matched").alias("matched"), "rank")


def fresh_links(pages: DataFrame, seen: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The best links of each page that no page of the run has brought up before (`seen`: key) and that the guard lets pass."""
    wide = page_links(pages, s.same_domain_only, s.max_pages_per_url * 3)
    new = wide.join(seen.select("key").distinct(), "key", "left_anti").filter(reject_reason(F.col("url"), s.allow_private_hosts) == "")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("rank"))
    return new.withColumn("rank", rank).filter(F.col("rank") <= s.max_pages_per_url)


def discover(pages: DataFrame, fetch_pages: Callable[[DataFrame], DataFrame], s: Settings = DEFAULTS) -> DataFrame:
    """depth, url, key, parent_url of every page found by following links level by level.

    fetch_pages turns (url, key, parent_url, depth) into rows with id, url and raw_html. The loop runs on the
    driver by depth; each level is cut off its lineage, and a link goes to the parent with the least id.
    """
    seen = cut(pages.select(dedup_key(F.col("url")).alias("key")).distinct())
    frontier, found = pages, None
    for depth in range(1, s.max_crawl_depth + 1):
        links = fresh_links(frontier, seen, s).groupBy("key").agg(F.min_by(F.struct("url", "page_url"), F.struct("page_id", "rank")).alias("l"))
        level = cut(links.select(F.lit(depth).alias("depth"), F.col("l.url").alias("url"), "key", F.col("l.page_url").alias("parent_url")))
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        seen = cut(seen.unionByName(level.select("key")))
        frontier = cut(fetch_pages(level))
    if found is None:
        return pages.sparkSession.createDataFrame([], "depth int, url string, key string, parent_url string")
    return found
