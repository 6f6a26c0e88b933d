"""A knowledge base in a folder of versioned Parquet tables, and the passes that move it forward.

Every pass reads the current version of its tables and writes the next one beside it; a version counts once
its success marker is there, so a failed pass leaves the old state readable and no path is overwritten
while it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.functions.people import extract_people
from lodestack.operators import answers, crawl, harvest, index, listing, log, records, search, upload
from lodestack.session import ship
from lodestack.settings import DEFAULTS, Settings
from lodestack.sources.fetching import CaptureFetcher, Fetcher, Resolver, fetch_all
from lodestack.sources.sheets import SheetError, detect_url_column, read_sheet

POSITIVE = 0x7FFFFFFFFFFFFFFF


def stable_id(*cols) -> F.Column:
    """A positive id that depends on the natural key alone."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(POSITIVE))


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULTS, resolver: Resolver | None = None, second: Fetcher | None = None, renderer: Fetcher | None = None):
        """resolver gives a host's addresses to the guard, second is the engine for pages that the first cannot reach, renderer a browser for thin and blocked ones."""
        ship(spark)
        self.spark, self.root, self.s = spark, root.rstrip("/"), settings
        self.resolver, self.second, self.renderer = resolver, second, renderer

    # versions ------------------------------------------------------------------------------------
    def _versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        dirs = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("v=")]
        return sorted(int(d.getName()[2:]) for d in dirs if fs.exists(jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        v = self._versions(name)
        df = self.spark.read.parquet(f"{self.root}/{name}/v={v[-1]:06d}") if v else schemas.empty(self.spark, name)
        return df if name == "vectors" or name == "chunks" and v else schemas.sync_columns(df, name)

    def write(self, name: str, df: DataFrame) -> None:
        v = self._versions(name)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={(v[-1] if v else 0) + 1:06d}")

    def _next_id(self, name: str) -> int:
        return (self.read(name).agg(F.max("id")).first()[0] or 0) + 1

    def _job(self, kind: str, batch_id: int | None, total: int, failed: int = 0, message: str = "") -> None:
        now = F.current_timestamp()
        row = self.spark.range(1).select(F.lit(self._next_id("harvest_jobs")).cast("long").alias("id"), F.lit(batch_id).cast("long").alias("batch_id"), F.lit(kind).alias("kind"), F.lit("success").alias("status"), F.lit(total).alias("total"), F.lit(total).alias("processed"), F.lit(total - failed).alias("succeeded"), F.lit(failed).alias("failed"), F.lit(message).alias("message"), F.lit("").alias("traceback"), now.alias("started_at"), now.alias("finished_at"))
        self.write("harvest_jobs", self.read("harvest_jobs").unionByName(row))

    # passes --------------------------------------------------------------------------------------
    def import_sheet(self, path: str, url_column: str | None = None) -> int:
        """A new batch of PENDING pages from a sheet; returns its id."""
        size = self.spark.read.format("binaryFile").load(path).select("length").first()
        upload.check_upload(size.length if size else 0, 0, self.s)
        sheet = read_sheet(self.spark, path)
        column = url_column or detect_url_column(sheet)
        if column is None or column not in sheet.columns:
            raise SheetError("no column of URLs; columns are " + ", ".join(sheet.columns))
        rows = upload.classify_rows(sheet.withColumn("_row", F.monotonically_increasing_id()), column, "_row", allow_private=self.s.allow_private_hosts)
        batch = self._next_id("upload_batches")
        counts = upload.bucket_counts(rows.withColumn("_one", F.lit(1)), ["_one"]).first()
        valid, total = (counts.valid, counts.total) if counts else (0, 0)
        upload.check_upload(size.length if size else 0, valid, self.s)
        new = upload.pending_rows(rows.drop("_row"), batch).withColumn("id", stable_id("batch_id", "normalized_url")).withColumn("created_at", F.current_timestamp())
        pages = self.read("harvested_urls")
        self.write("harvested_urls", pages.unionByName(schemas.sync_columns(new, "harvested_urls").select(*pages.columns)))
        reasons = upload.rejected_map(rows.withColumn("_one", F.lit(1)), ["_one"]).first()
        head = self.spark.createDataFrame([(batch, path.rsplit("/", 1)[-1], path, total, valid, total - valid, column, sheet.columns, dict(reasons.rejected_json) if reasons else {}, "uploaded", counts.summary if counts else "")], "id long, original_filename string, stored_path string, row_count int, url_count int, skipped_rows int, url_column string, headers array<string>, rejected_json map<string,int>, status string, notes string").withColumn("uploaded_at", F.current_timestamp())
        self.write("upload_batches", self.read("upload_batches").unionByName(head))
        return batch

    def harvest(self, fetcher: Fetcher | None = None, batch_id: int | None = None) -> None:
        """Fetches and classifies the pending pages, follows links where settings say so."""
        fetcher = fetcher or CaptureFetcher({})
        pages = self.read("harvested_urls")
        todo = pages.filter("crawl_status = 'PENDING'")
        todo = todo if batch_id is None else todo.filter(F.col("batch_id") == batch_id)
        self.write("fetch_results", harvest.extract_pages(fetch_all(todo.select("url"), fetcher, self.s, resolver=self.resolver, second=self.second), self.s))
        got = self.read("fetch_results")
        if self.renderer is not None:
            thin = got.filter(F.col("crawl_status").isin("PARTIAL", "BLOCKED")).select("url")
            seen = harvest.extract_pages(fetch_all(thin, self.renderer, self.s, resolver=self.resolver), self.s)
            self.write("fetch_results", harvest.rerendered(got, schemas.sync_columns(seen, "fetch_results").select(*got.columns), self.s))
            got = self.read("fetch_results")
        self.write("harvested_urls", harvest.store_results(pages, got))
        n = got.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("crawl_status").isin("SUCCESS", "PARTIAL")).alias("f")).first()
        self._job("harvest", batch_id, n.n, n.f)
        if self.s.discover_links:
            self._discover(fetcher, batch_id)

    def _discover(self, fetcher: Fetcher, batch_id: int | None) -> None:
        pages = self.read("harvested_urls")
        seeds = pages if batch_id is None else pages.filter(F.col("batch_id") == batch_id)
        owner = seeds.groupBy(F.col("url").alias("parent_url")).agg(F.min("batch_id").alias("batch_id"))

        def level(links: DataFrame) -> DataFrame:
            got = harvest.extract_pages(fetch_all(links.select("url"), fetcher, self.s, resolver=self.resolver, second=self.second), self.s)
            new = links.join(owner, "parent_url", "left").select(F.coalesce("batch_id", F.lit(batch_id).cast("long")).alias("batch_id"), "url", F.col("key").alias("normalized_url"), F.col("depth").alias("crawl_depth"), "parent_url", F.lit("PENDING").alias("crawl_status"))
            new = schemas.sync_columns(new.withColumn("id", stable_id("batch_id", "normalized_url")), "harvested_urls")
            current = self.read("harvested_urls")
            stored = harvest.store_results(new, got).select(*current.columns)
            self.write("harvested_urls", current.unionByName(stored))
            return self.read("harvested_urls").join(links.select(F.col("key").alias("normalized_url")), "normalized_url", "left_semi").select("id", "url", "raw_html")

        crawl.discover(seeds.select("id", "url", "raw_html"), level, self.s)

    def index(self, batch_id: int | None = None, rebuild: bool = False) -> None:
        pages = self.read("harvested_urls")
        n = index.targets(pages, batch_id, rebuild).count()
        chunks = self.read("chunks")
        chunks = chunks if "chunk_id" in chunks.columns else chunks.select(F.col("id").alias("chunk_id"), "url_id", "ordinal", "text", "char_start", "char_end", "heading")
        p, c, v = index.reindex(pages, chunks, self.read("vectors"), batch_id, rebuild, self.s)
        self.write("chunks", c)
        self.write("vectors", v)
        self.write("harvested_urls", p)
        self._job("index", batch_id, n)

    def extract(self, force: bool = False, completer_records: DataFrame | None = None) -> None:
        """People of pages not yet extracted, merged with model records (url_id, pos, fields) where there are any."""
        pages = self.read("harvested_urls")
        todo = records.pages_to_extract(pages, force)
        found = records.coerce(extract_people(todo, self.s).withColumn("pos", F.col("rank")))
        model = completer_records if completer_records is not None else found.limit(0)
        merged = records.limited(records.merge_records(model, found))
        chunks = self.read("chunks")
        linked = records.link_chunks(merged, chunks.select("url_id", "chunk_id", "text")) if "chunk_id" in chunks.columns else merged.withColumn("source_chunk_ids", F.array().cast("array<bigint>"))
        fresh = linked.join(todo.select(F.col("id").alias("url_id"), "batch_id"), "url_id").select(stable_id("url_id", F.lower("name")).alias("id"), "url_id", "batch_id", *records.FIELDS, "source_chunk_ids", "confidence", F.to_json(F.struct(*records.FIELDS, "confidence")).alias("raw_json"), F.current_timestamp().alias("extracted_at"))
        # pages that lost their text lose their people, too
        bare = pages.filter(F.coalesce("text_content", F.lit("")) == "").select(F.col("id").alias("url_id"))
        touched = todo.select(F.col("id").alias("url_id")).unionByName(bare)
        self.write("person_records", records.replace_for_pages(self.read("person_records"), fresh, touched))
        done = todo.select(F.col("id").alias("_id"))
        mark = F.map_concat(F.map_filter(F.coalesce("meta_json", F.create_map().cast("map<string,string>")), lambda k, v: k != "people_extracted"), F.create_map(F.lit("people_extracted"), F.lit("1")))
        counted = records.counts_on_pages(pages, self.read("person_records"), "url_id", "person_count").join(done, F.col("id") == F.col("_id"), "left")
        self.write("harvested_urls", counted.withColumn("meta_json", F.when(F.col("_id").isNotNull(), mark).otherwise(F.col("meta_json"))).select(*pages.columns))
        self._job("extract", None, todo.count())

    def reextract(self) -> None:
        self.write("harvested_urls", harvest.reextract(self.read("harvested_urls"), self.s))

    def search(self, *questions: str) -> DataFrame:
        q = self.spark.createDataFrame([(i, t) for i, t in enumerate(questions)], "query_id long, query string")
        people = self.read("person_records")
        found = search.search(q, self.read("chunks"), self.read("vectors"), self.read("harvested_urls"), people, self.s)
        log.append(log.log_rows(q, found, self.s.search_top_k), f"{self.root}/search_log")
        return found

    def answer(self, *questions: str, completer: answers.Completer | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Answers (query_id, query, answer, note), the sources they cite and the person cards of each question."""
        found = self.search(*questions)
        asked = found.select("query_id", "query").distinct()
        said = answers.answer(found, asked, completer, self.s)
        sources = answers.cited_sources(said, answers.context_slots(found, self.s))
        people = search.rank_people(found.filter("page_rank is not null").join(said.select("query_id", "answer"), "query_id"), self.s)
        return said, sources, people

    def stats(self) -> DataFrame:
        return listing.table_counts(batches=self.read("upload_batches"), chunks=self.read("chunks"), people=self.read("person_records"), urls=self.read("harvested_urls"), vectors=self.read("vectors"))
