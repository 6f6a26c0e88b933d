"""Problem 4: template residue, filler and error-page text in place of content.

Method: numbers, addresses, dates, quoted names and paths of each line are masked and the lines are grouped
by the hash of their masked form across sources. A form that several sources share, and that mostly stands
where the row has no longer line of its own beside it, is what a server says in place of content: menus and
notices of sites recur too, but mostly beside content. Phrase rules classify what recurs and name the
messages of too few sources to recur; placeholders and filler are told by rules on single lines, also
inside real text.

Plan: one scan turns every line into a hash and three flags, which are kept; forms are partial
aggregations over those, joined back once.

Defined results: null, empty and blank texts are no cases; a text that only speaks of messages or quotes
a placeholder in backticks is none; repeated rows are reported once for each id.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.urls import domain_of
from lodestack.session import cut

#: A masked form must recur at this many sources, and stand alone in this part of its rows, to be a message.
MIN_SOURCES, ALONE = 3, 0.6
#: A row has content beside a line if another line is longer than this many characters.
CONTENT = 170

#: Unfilled placeholders of common template languages and of forms (fixed patterns), each with texts of which any match holds one.
PLACEHOLDERS = [
    (("{{",), r"(?<!`)\{\{[^{}\n]{1,60}\}\}(?!`)"),
    (("{%",), r"(?<!`)\{%[^{}%\n]{1,60}%\}(?!`)"),
    (("<%",), r"<%[=#-]?[^%<>\n]{1,60}%>"),
    (("${",), r"\$\{[^{}\n]{1,60}\}"),
    (("{",), r"(?<![`{$])\{[a-z]+(?:[_.][a-z]+)*\}(?![`}])"),
    (("%(",), r"%\([a-z_]+\)[sdf]"),
    (("%",), r"(?<![\w%])%[A-Z]{2,}(?:_[A-Z]+)*%(?![\w%])"),
    (("@@",), r"@@[A-Za-z_]+@@"),
    (("##",), r"##[A-Za-z]+(?:_[A-Za-z]+)*##"),
    (("__",), r"(?<![\w_])__[A-Za-z]+(?:_[A-Za-z]+)*__(?![\w_])"),
    (("[",), r"\[\[[a-z_ .]{1,60}\]\]|\[(?:[Ii]nsert|[Ee]nter|[Aa]dd|[Yy]our|[Tt]ype) [^\[\]\n]{1,60}\]|\[[A-Z]{2,}(?: [A-Z]{2,}){0,4}\]"),
    (("<",), r"<(?!(?:b|i|u|a|p|em|br|hr|li|ul|ol|td|tr|th|div|span|strong|small|code|pre|body|head|html|table|img|sup|sub|nav|main|section)>)[a-z]{3,}(?: [a-z]+){0,4}>"),
    (("«",), r"«[a-z]+(?: [a-z]+){0,3}»"),
    (("goes here", "goes_here"), r"\b[A-Z]{2,}(?:_[A-Z]+)*_GOES_HERE\b|(?i:\byour (?:\w+ ){1,4}goes here\b)"),
]
#: Words without which no dozen words of prose go by (fixed values: English, German, French, Spanish, Italian, Portuguese, Dutch).
FUNCTION_WORDS = (
    "the a an of and or to in on at for with from by as is are was were be been it its that this which who not but if than then he she they we you his her their our has have had will would can may all no so do "
    "der die das den dem des ein eine einen einem und oder zu im in am von mit für auf aus bei nach ist sind war hat haben wird nicht auch als wie sich er sie es wir ihr dass noch nur um "
    "le la les un une des du de et ou à au aux en dans sur pour par avec est sont a ont il elle ils qui que ne pas plus se ce son sa ses leur nous vous "
    "el los las unos unas y o del al con por para es son fue ha han no se lo su sus como más que "
    "il lo gli i uno e di da che non per si è sono ha come della nel os as um uma do da dos das em no na com não het een van en met op te dat niet voor zijn"
)
_LOWER = "[a-zß-öø-ÿ]"
#: Filler and layout text (fixed patterns), hinted like the placeholders; the last is a run of words in which no function word stands.
FILLERS = [
    (("lorem ipsum",), r"(?i:\blorem ipsum\b(?! ?[”\"»’']))"),
    (("dummy", "placeholder", "filler", "sample"), r"(?i:^\W*(?:dummy|placeholder|filler|sample) (?:content|text|copy) for\b|\bthis is (?:sample|dummy|placeholder|filler) (?:text|content|copy)\b)"),
    (("copy to be supplied by", "type your", "remove this hint"), r"(?i:\b(?:body )?copy to be supplied by\b|\btype your (?:\w+ ){1,4}here\b|\bremove this hint when done\b)"),
    (("asdf", "qwerty", "foo", "bar", "blah", "xxx", "test"), r"(?i:\b(?:asdf|qwerty|foo|bar|blah|xxx|test)(?:\s+(?:asdf|qwerty|foo|bar|blah|xxx|test|text)){3,})"),
    (("heading",), r"(?i:^\W*(?:sub)?heading #?\d+\W*$)"),
    (("",), rf"(?<![\w’'-])(?:(?!(?:{'|'.join(sorted(set(FUNCTION_WORDS.split())))}) ){_LOWER}{{2,}}+ ){{11}}{_LOWER}{{2,}}+"),
]
#: Messages of servers, scripts and checks that take a page's place: the whole line (fixed patterns).
MESSAGE = (
    r"(?i)^[\s#*>•-]*(?:"
    r"error \d+: the \w+ you (?:asked|were looking) for .{0,40}"
    r"|(?:oops|whoops)!? (?:that|this|the) \w+ (?:has gone missing|is missing|could not be found|does not exist)"
    r"|sorry,? (?:this|that|the) \w+ (?:is no longer available|could not be found|does not exist|has been removed)"
    r"|access denied\b.{0,90}"
    r"|(?:\d+ )?(?:forbidden|unauthori[sz]ed)|(?:\d+\s*)?(?:page )?not found"
    r"|rate limit exceeded\b.{0,50}|too many requests\b.{0,60}"
    r"|service (?:temporarily )?unavailable\b.{0,60}|bad gateway\b.{0,80}|gateway time-?out\b.{0,60}|internal server error\b.{0,60}"
    r"|could not connect to the database\b.{0,70}|error establishing a database connection"
    r"|traceback \(most recent call last\):?.*|fatal error: call to undefined function .*|[a-z]+(?:\.[a-z]+)*\.\w*(?:exception|error)(?::.*)?"
    r"|\w+error: '\w+'"
    r"|please (?:enable|turn on|switch on|activate|allow) (?:javascript|scripts|cookies)\b.{0,60}"
    r"|something went wrong(?: on our (?:side|end))?[.,!]? (?:please )?(?:try|reload|come back)\b.{0,60}"
    r"|we are checking (?:that|whether|if) your (?:connection|browser)\b.{0,70}"
    r"|your session (?:has (?:ended|expired)|timed out)\b.{0,70}"
    r"|(?:loading|one moment)\s?(?:…|\d+|\.\.\.)? if nothing happens, allow scripts.{0,30}"
    r"|your browser is out of date or blocks scripts\b.{0,60}"
    r"|this (?:application|page|site|resource) needs scripts to run\b.{0,80}"
    r"|verify (?:that )?you are (?:a )?human\b.{0,70}|checking (?:the|your) (?:connection|browser) before.{0,60}"
    r"|veuillez activer (?:les scripts|javascript)\b.{0,70}|bitte aktivieren sie (?:javascript|skripte)\b.{0,70}"
    r"|page introuvable\b.{0,70}|seite nicht gefunden\b.{0,80}|lo sentimos, la página .{0,60}no existe.{0,30}"
    r"|[45]\d\d"
    r")[\s.!…»]*$"
)
#: Lines that come with a trace (fixed patterns).
TRACE = r"^\s*(?:at [\w.$]+\(.*\)|File \".*\", line \d+.*)\s*$"
_MESSAGE, _TRACE = re.compile(MESSAGE), re.compile(TRACE)
_RULES = [(hints, re.compile(p)) for hints, p in (*PLACEHOLDERS, *FILLERS)]


@lru_cache(maxsize=100_000)
def is_residue_line(line: str) -> bool:
    """Whether a single line is a message, or holds a placeholder or filler."""
    low = line.lower()
    return bool(_MESSAGE.match(line) or _TRACE.match(line)) or any(any(h in low for h in hints) and p.search(line) for hints, p in _RULES)


def _any(line: Column, low: Column, rules: list) -> Column:
    """Whether one of the rules matches; a pattern is searched only in lines that hold one of its hints."""
    out = F.lit(False)
    for hints, p in rules:
        hinted = F.lit(True)
        if all(hints):
            hinted = F.contains(low, F.lit(hints[0]))
            for h in hints[1:]:
                hinted = hinted | F.contains(low, F.lit(h))
        out = out | (hinted & line.rlike(p))
    return out


def mask(line: Column) -> Column:
    """Lower-case form with addresses, paths, quoted names, dates and numbers masked, without space and marks."""
    x = F.lower(line)
    odd = F.contains(x, F.lit("/")) | F.contains(x, F.lit("@")) | F.contains(x, F.lit("www.")) | F.contains(x, F.lit("'")) | F.contains(x, F.lit('"')) | F.contains(x, F.lit("()"))
    x = F.when(odd, F.regexp_replace(x, r"\S*(?:://|www\.|@)\S+|(?:/[\w.-]+){2,}|'[^']*'|\"[^\"]*\"|\w+\(\)", "@")).otherwise(x)
    return F.translate(x, "0123456789 \t\r\u00a0.,:;!?…»«|·-–—/()#*[]", "")


def _rows(df: DataFrame, name: str, row_id: str, url: str, text: str) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), domain_of(F.col(url)).alias("source"), F.col(text).alias("text")).filter(F.col("row_id").isNotNull() & (F.trim("text") != ""))


def corpus_rows(fetches: DataFrame, pages: DataFrame) -> DataFrame:
    return _rows(fetches, "fetch_results", "fetch_id", "url", "text").unionByName(_rows(pages, "harvested_urls", "id", "normalized_url", "text_content"))


def coded_lines(rows: DataFrame) -> DataFrame:
    """table_name, row_id, source and form (hashes), alone, placeholder, filler, named of each line that is not blank."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.rtrim(F.translate(x, "\r", ""))), lambda x: x != "")
    x = rows.select("table_name", "row_id", F.xxhash64("source").alias("source"), lines.alias("lines"))
    # lines that are content by their length: none, one (which has itself no content beside it), or more
    x = x.withColumn("big", F.aggregate("lines", F.lit(0), lambda n, s: n + (F.length(s) > CONTENT).cast("int")))
    x = x.select("table_name", "row_id", "source", "big", F.explode("lines").alias("line")).withColumn("low", F.lower("line"))
    alone = F.col("big") <= (F.length("line") > CONTENT).cast("int")
    line, low = F.col("line"), F.col("low")
    return x.select("table_name", "row_id", "source", F.xxhash64(mask(line)).alias("form"), alone.alias("alone"), _any(line, low, PLACEHOLDERS).alias("placeholder"), _any(line, low, FILLERS).alias("filler"), line.rlike(MESSAGE).alias("named"))


def recurring_messages(lines: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """form, n_sources of masked forms that several sources share and that mostly stand alone (pre-aggregated by source)."""
    per = lines.groupBy("form", "source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("alone"), 1)).alias("a"))
    return per.groupBy("form").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("n"), F.sum("a").alias("a")).filter((F.col("n_sources") >= min_sources) & (F.col("a") >= ALONE * F.col("n"))).select("form", "n_sources")


def residue_rows(fetches: DataFrame, pages: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """table_name, row_id, reason of rows with placeholders, filler or a message in place of content."""
    lines = cut(coded_lines(corpus_rows(fetches, pages)))
    wide = recurring_messages(lines, min_sources).select("form", F.lit(True).alias("wide"))
    by_rule = lines.filter("placeholder or filler or named").select("table_name", "row_id", F.when(F.col("placeholder"), 1).when(F.col("filler"), 2).otherwise(3).alias("r"))
    by_form = lines.join(wide, "form", "left_semi").select("table_name", "row_id", F.lit(3).alias("r"))
    best = by_rule.unionByName(by_form).groupBy("table_name", "row_id").agg(F.min("r").alias("r"))
    return best.select("table_name", "row_id", F.element_at(F.array(F.lit("placeholder"), F.lit("filler"), F.lit("message")), F.col("r")).alias("reason"))
