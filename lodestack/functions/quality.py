"""The content-quality gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import char_count, line_count, strip, word_count
from lodestack.settings import DEFAULTS, Settings


def assess(text: Column, s: Settings = DEFAULTS) -> Column:
    """struct(ok, reason, char_count, word_count, line_count, words_per_line) of a text; null counts as empty."""
    chars, words, lines = char_count(text), word_count(text), line_count(text)
    per_line = F.when(lines > 0, words / lines).otherwise(F.lit(0.0))
    reason = (
        F.when(strip(F.coalesce(text, F.lit(""))) == "", F.lit("no extractable text"))
        .when(chars < s.min_text_chars, F.concat(F.lit("insufficient extractable content ("), chars.cast("string"), F.lit(" characters)")))
        .when(words < s.min_text_words, F.concat(F.lit("insufficient extractable content ("), words.cast("string"), F.lit(" words)")))
        .when((lines >= s.nav_min_lines) & (per_line < s.nav_words_per_line), F.lit("page yielded navigation rather than content"))
        .otherwise(F.lit(""))
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"), chars.alias("char_count"), words.alias("word_count"), lines.alias("line_count"), per_line.alias("words_per_line"))


def summary(report: Column) -> Column:
    return F.format_string("%d chars, %d words, %d lines, %.1f words/line", report["char_count"], report["word_count"], report["line_count"], report["words_per_line"])
