"""Text functions as native expressions. Null text counts as empty unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CITATION = r"[\[【](\d+)[^\]】]*[\]】]"
OMITTED = "\n\n[...middle of page omitted...]\n\n"


def as_text(c: Column) -> Column:
    """Any value as trimmed text, null as ""."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def strip(c: Column) -> Column:
    """Trims every kind of white space, not just blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Lower case with every run of Unicode white space as one blank."""
    return F.lower(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s   ]+", " ")))


def char_count(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit(""))))


def word_count(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"(?U)\s+")))


def filled_lines(c: Column) -> Column:
    """The non-blank lines of a text, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\u000b\u000c\u0085  ]"), strip), lambda x: x != "")


def line_count(c: Column) -> Column:
    return F.size(filled_lines(c))


def clean_document(c: Column) -> Column:
    """Squeezes the ragged white space of extracted documents: one blank in lines, one blank line between."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def chunk_normal(c: Column) -> Column:
    """The form in which texts are chunked: lines trimmed, one- and two-character lines dropped, blanks squeezed."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), "\n"), strip)
    kept = F.filter(lines, lambda x: (x == "") | (F.length(x) >= 3))
    return strip(F.regexp_replace(F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"[ \t]+", " ")), "\n"), r"\n{3,}", "\n\n"))


def shorten(c: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something was cut."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def truncate_for_prompt(c: Column, head: int = 6000, tail: int = 2000) -> Column:
    return F.when(F.length(c) > head + tail, F.concat(F.substring(c, 1, head), F.lit(OMITTED), F.right(c, F.lit(tail)))).otherwise(c)


def content_hash(c: Column) -> Column:
    """sha256 of the text, "" for none."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.sha2(c, 256))


def citations(answer: Column) -> Column:
    """The numbers an answer cites, in order, repeats included."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("int"))


def unfence(reply: Column) -> Column:
    return strip(F.regexp_replace(strip(F.coalesce(reply, F.lit(""))), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply as text: the whole reply, else from its first to its last brace."""
    bare = unfence(reply)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare), F.when(F.try_parse_json(inner).isNotNull(), inner))


def clamp_unit(c: Column) -> Column:
    """A confidence as double between 0 and 1; what is no number becomes null."""
    n = c.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def show_time(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("—"))
