"""Answers over search results: context slots, completion by a pluggable model, citations."""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestack.functions.text import citations
from lodestack.settings import DEFAULTS, Settings

SYSTEM_PROMPT = "Answer only from the numbered context. Cite entries as [1], [2]. Say so when the context holds no answer. Lead with name, title and company when the question is about a person."


class CompletionUnavailable(RuntimeError):
    """No model could answer."""


class Completer(Protocol):
    def __call__(self, system: str, user: str) -> str: ...


class NoCompleter:
    """The default: there is no model, so there is no answer."""

    def __call__(self, system: str, user: str) -> str:
        raise CompletionUnavailable("no completion provider is configured")


class FallbackCompleter:
    """Tries completers in turn, each twice."""

    def __init__(self, *completers: Completer):
        self.completers = completers

    def __call__(self, system: str, user: str) -> str:
        last: Exception = CompletionUnavailable("no completion provider is configured")
        for c in self.completers:
            for _ in range(2):
                try:
                    return c(system, user)
                except Exception as e:
                    last = e
        raise CompletionUnavailable(str(last))


def context_slots(results: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """query_id, slot (from 1), title, url, text of every matched chunk in page and chunk order.

    results: query_id, page_rank, title, url, matched_chunks with a payload text. All slots are numbered, as
    citations resolve against all of them; only the first synthesis_chunks are shown to a model.
    """
    per = results.filter("page_rank is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("page_rank", "title", "url", "matched_chunks"))).alias("l"))
    flat = F.flatten(F.transform("l", lambda p: F.transform(p["matched_chunks"], lambda c: F.struct(p["title"].alias("title"), p["url"].alias("url"), c["payload"]["text"].alias("text")))))
    return per.select("query_id", F.posexplode(flat).alias("i", "c")).select("query_id", (F.col("i") + 1).alias("slot"), "c.title", "c.url", "c.text")


def build_context(slots: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """query_id, context: the first slots as `[n] title`, `URL: ...` and text."""
    entry = F.concat(F.lit("["), F.col("slot").cast("string"), F.lit("] "), F.col("title"), F.lit("\nURL: "), F.col("url"), F.lit("\n"), F.col("text"))
    shown = slots.filter(F.col("slot") <= s.synthesis_chunks)
    return shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("context"))


def cited_sources(answers: DataFrame, slots: DataFrame) -> DataFrame:
    """query_id, source_rank, cited (number), url, title: the pages an answer cites, each once, in citation order."""
    c = answers.select("query_id", F.posexplode(F.array_distinct(citations(F.col("answer")))).alias("pos", "cited"))
    j = c.join(slots.select("query_id", F.col("slot").alias("cited"), "url", "title"), ["query_id", "cited"])
    one = j.groupBy("query_id", "url").agg(F.min_by(F.struct("pos", "cited", "title"), "pos").alias("x"))
    l = one.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("x.pos").alias("pos"), F.col("x.cited").alias("cited"), "url", F.col("x.title").alias("title")))).alias("l"))  # noqa: E741
    return l.select("query_id", F.posexplode("l").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("source_rank"), "x.cited", "x.url", "x.title")


def complete(prompts: Column, completer: Completer | None = None) -> Column:
    """struct(answer, note): a failing or missing model gives an empty answer and says why."""
    c = completer or NoCompleter()

    @F.arrow_udf(StructType([StructField("answer", StringType()), StructField("note", StringType())]))
    def run(users: pa.Array) -> pa.Array:
        rows = []
        for u in users.to_pylist():
            if not u:
                rows.append({"answer": "", "note": "nothing to answer from"})
                continue
            try:
                rows.append({"answer": c(SYSTEM_PROMPT, u), "note": ""})
            except CompletionUnavailable as e:
                rows.append({"answer": "", "note": f"answer unavailable: {e}"})
            except Exception as e:
                rows.append({"answer": "", "note": f"answer unavailable: {type(e).__name__}"})
        return pa.array(rows, pa.struct([("answer", pa.string()), ("note", pa.string())]))

    return run(prompts)


def answer(results: DataFrame, queries: DataFrame, completer: Completer | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """query_id, query, answer, note of each question, over its context."""
    ctx = build_context(context_slots(results, s), s)
    j = queries.select("query_id", "query").join(ctx, "query_id", "left")
    user = F.when(F.col("context").isNotNull(), F.concat(F.lit("CONTEXT:\n"), F.col("context"), F.lit("\n\nQUESTION: "), F.col("query")))
    return j.withColumn("_a", complete(user, completer)).select("query_id", "query", F.col("_a.answer").alias("answer"), F.col("_a.note").alias("note"))
