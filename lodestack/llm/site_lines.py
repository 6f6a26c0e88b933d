"""Problem 3: lines repeated across one site's documents.

Method: the lines of a site are nodes weighted by the number of pages that hold them, neighbouring
lines are edges weighted likewise; nodes and edges with enough support are kept, connected components
are the site's boilerplate blocks, and every occurrence of a block's line is deleted.

A line's key is its lower-cased letters; lines without letters are no nodes. The site is the host of
normalized_url without a leading `www.`. Rows without text, id or host have no lines. A page that holds
a line twice supports it once; several rows with one id are one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.urls import domain_of
from lodestack.operators.graph import connected_components
from lodestack.session import cut

MIN_PAGES = 5
#: Occurrences are spread over this many salts, so that no line of a huge site is one task's work.
SALTS = 16


def line_key(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), r"\P{L}+", "")


def page_lines(pages: DataFrame) -> DataFrame:
    """id, site, line_no (from 1, blank lines counted), key of each line that has letters."""
    base = pages.select(F.col("id"), domain_of(F.col("normalized_url")).alias("site"), F.col("text_content").alias("t")).filter("id is not null and t <> '' and site <> ''")
    keys = base.select("id", "site", F.posexplode(F.transform(F.split("t", "\n", -1), line_key)).alias("p", "key"))
    return keys.filter("key <> ''").select("id", "site", (F.col("p") + 1).alias("line_no"), "key")


def _coded(lines: DataFrame) -> DataFrame:
    return lines.select("id", "site", "line_no", "key", F.xxhash64("site", "key").alias("h"), F.hash("key", "site").alias("g"))


def nodes(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """h, g (two hashes of site and key), support of each line that min_pages pages of its site hold."""
    base = pages.select("id", domain_of(F.col("normalized_url")).alias("site"), F.col("text_content").alias("t")).filter("id is not null and t <> '' and site <> ''")
    once = base.select("id", F.explode(F.array_distinct(F.transform(F.split("t", "\n", -1), lambda x: F.struct(F.xxhash64("site", line_key(x)).alias("h"), F.hash(line_key(x), "site").alias("g"), (line_key(x) != "").alias("ok"))))).alias("n")).filter("n.ok")
    # ids are unique in harvested_urls; the distinct also holds where rows are repeated
    per = once.select("n.h", "n.g", "id")
    return per.groupBy("h", "g").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= min_pages).select("h", "g", "rows")


def _exact(pages: DataFrame, min_pages: int) -> DataFrame:
    """Supports over distinct ids: only candidates that pass by rows are counted by id."""
    cand = nodes(pages, min_pages)
    repeated = pages.groupBy("id").count().filter("count > 1").select("id")
    if repeated.isEmpty():
        return cand.select("h", "g", F.col("rows").alias("support"))
    lines = _coded(page_lines(pages)).select("h", "g", "id").join(cand.select("h", "g"), ["h", "g"]).distinct()
    return lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= min_pages)


def _block_of_lines(occ: DataFrame, min_pages: int) -> DataFrame:
    """h, block (number) of each node of enough support: components over the edges of enough support; a node without such an edge is a block of one."""
    # consecutive kept lines of a page; blank or letterless lines between them do not part a block
    nxt = occ.groupBy("id", "site").agg(F.array_sort(F.collect_list(F.struct("line_no", "h"))).alias("l"))
    pairs = nxt.select("id", "site", F.explode(F.array_distinct(F.expr("transform(filter(sequence(1, size(l)), i -> i < size(l) and l[i].line_no - l[i-1].line_no <= 2 and l[i].h <> l[i-1].h), i -> struct(least(l[i].h, l[i-1].h) as a, greatest(l[i].h, l[i-1].h) as b))"))).alias("e"))
    edges = pairs.groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("w")).filter(F.col("w") >= min_pages)
    comp = connected_components(edges)
    known = occ.select("h").distinct()
    return known.join(comp, known.h == comp.node, "left").select("h", F.coalesce("component", "h").alias("block"))


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, line_no (and what `keep` names) of every occurrence of a line of the sites' blocks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    lines = _coded(page_lines(pages)).withColumn("salt", F.pmod(F.col("id"), F.lit(SALTS)).cast("int"))
    held = dict.fromkeys(["id", "site", "line_no", "h", "salt", *(c for c in keep if c != "block")])
    occ = cut(lines.join(_exact(pages, min_pages).withColumn("salt", salts), ["h", "g", "salt"]).select(*held).distinct())
    return occ.join(_block_of_lines(occ, min_pages).withColumn("salt", salts), ["h", "salt"]).select("id", "line_no", *keep)


def line_blocks(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """site, block (number), n_lines, support (of its best line), lines: the boilerplate blocks of each site."""
    occ = repeated_lines(pages, min_pages, ("site", "key", "h", "support", "block"))
    known = occ.groupBy("h").agg(F.first("site").alias("site"), F.first("key").alias("key"), F.max("support").alias("support"), F.first("block").alias("block"))
    return known.groupBy("site", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.max("support").alias("support"), F.sort_array(F.collect_list("key")).alias("lines"))


def without_repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """id, clean_text, removed_lines of every page; null text stays null."""
    drop = repeated_lines(pages, min_pages).groupBy("id").agg(F.collect_list("line_no").alias("gone"))
    kept = F.expr("array_join(filter(split(text_content, '\\n', -1), (x, i) -> not array_contains(coalesce(gone, cast(array() as array<int>)), i + 1)), '\\n')")
    return pages.select("id", "text_content").join(drop, "id", "left").select("id", kept.alias("clean_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))
