"""Person records: coercion of model output, merge of two readers, storage per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.text import as_text, clamp_unit, json_object

FIELDS = ("name", "title", "company", "location", "email", "phone", "linkedin_url", "bio")
LIMITS = {"name": 500, "title": 500, "company": 500, "location": 500, "email": 500, "phone": 120, "linkedin_url": 1000}


def coerce(df: DataFrame) -> DataFrame:
    """Every field as trimmed text ("" for missing), confidence as a double between 0 and 1 or null."""
    have = set(df.columns)
    new = {f: as_text(F.col(f)) if f in have else F.lit("") for f in FIELDS}
    new["confidence"] = clamp_unit(F.col("confidence").cast("string")) if "confidence" in have else F.lit(None).cast("double")
    return df.withColumns(new)


def records_from_replies(replies: DataFrame) -> DataFrame:
    """url_id, pos and the fields of every person in model replies (url_id, reply); malformed replies give none."""
    fields = ", ".join(f"{f} string" for f in (*FIELDS, "confidence"))
    parsed = F.from_json(json_object(F.col("reply")), f"people array<struct<{fields}>>", {"mode": "PERMISSIVE"})
    e = replies.select("url_id", F.posexplode(parsed["people"]).alias("pos", "p"))
    return coerce(e.filter("p is not null").select("url_id", "pos", "p.*"))


def merge_records(model: DataFrame, pattern: DataFrame) -> DataFrame:
    """One record for each name (case-insensitive) of a page: the model's fields, blanks filled from the pattern's.

    Inputs: url_id, pos, the fields, confidence (pattern also evidence). A name the model repeats keeps its
    first position and its last values. Order: the model's records, then what only the pattern found.
    """
    key = F.lower("name")
    cols = [*FIELDS, "confidence"]
    m = model.filter("name <> ''").groupBy("url_id", key.alias("k")).agg(F.max_by(F.struct(*cols), "pos").alias("m"), F.min("pos").alias("mp"))
    p = pattern.filter("name <> ''").groupBy("url_id", key.alias("k")).agg(F.min_by(F.struct(*cols, "evidence"), "pos").alias("p"), F.min("pos").alias("pp"))
    j = m.join(p, ["url_id", "k"], "full_outer")
    fill = lambda f: F.coalesce(F.nullif(f"m.{f}", F.lit("")), f"p.{f}", F.lit("")).alias(f)
    conf = F.when(F.coalesce("m.confidence", F.lit(0.0)) != 0, F.col("m.confidence")).otherwise(F.coalesce("p.confidence", "m.confidence"))
    rank = F.row_number().over(Window.partitionBy("url_id").orderBy(F.col("m").isNull(), F.coalesce("mp", "pp"), "k"))
    return j.withColumn("rank", rank).select("url_id", "rank", *[fill(f) for f in FIELDS], conf.alias("confidence"), F.when(F.col("m").isNotNull(), F.coalesce("p.evidence", F.lit(""))).otherwise(F.lit("")).alias("pattern_evidence"))


def link_chunks(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds source_chunk_ids: the chunks of the same page whose text holds the name; none gives an empty list."""
    key = records.select("url_id", F.lower("name").alias("_k")).filter("_k <> ''").distinct()
    hit = key.join(chunks.select("url_id", "chunk_id", F.lower("text").alias("_t")), "url_id").filter(F.contains("_t", "_k"))
    ids = hit.groupBy("url_id", "_k").agg(F.array_sort(F.collect_list("chunk_id")).alias("source_chunk_ids"))
    out = records.withColumn("_k", F.lower("name")).join(ids, ["url_id", "_k"], "left").drop("_k")
    return out.withColumn("source_chunk_ids", F.coalesce("source_chunk_ids", F.array().cast("array<bigint>")))


def limited(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.substring(c, 1, n) for c, n in LIMITS.items()})


def replace_for_pages(stored: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored records with those of the given pages (url_id) replaced by the new ones, also by none."""
    kept = stored.join(pages.select("url_id").distinct(), "url_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def pages_to_extract(pages: DataFrame, force: bool = False) -> DataFrame:
    """Pages with text that were never extracted, or whose extraction found nobody; all of them with force."""
    text = pages.filter(F.coalesce("text_content", F.lit("")) != "")
    if force:
        return text
    done = F.coalesce(F.try_element_at("meta_json", F.lit("people_extracted")), F.lit("")) != ""
    return text.filter(~((F.coalesce("person_count", F.lit(0)) > 0) & done))


def best_per_name(df: DataFrame, page: str, name: str, title: str, tie: str) -> DataFrame:
    """Of each page and name (case-insensitive) the row with the longest title, the least `tie` among equals."""
    rest = [c for c in df.columns if c != page]
    best = df.groupBy(F.col(page), F.lower(name).alias("_k")).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(F.length(title), F.lit(0)), -F.col(tie))).alias("r"))
    return best.select(page, *[F.col(f"r.{c}").alias(c) for c in rest])


def counts_on_pages(pages: DataFrame, children: DataFrame, child_key: str, count_col: str) -> DataFrame:
    """The page table with a counter column recomputed from a child table."""
    n = children.groupBy(F.col(child_key).alias("_id")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return pages.join(n, pages.id == n["_id"], "left").withColumn(count_col, F.coalesce("_n", F.lit(0))).drop("_id", "_n")


def confidence_order() -> list[Column]:
    return [F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc(F.length("title")), F.asc("name")]
