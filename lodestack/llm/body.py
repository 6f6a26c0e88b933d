"""Problem 2: keep the main body of each page.

Method: the standard library's streaming HTML parser gives events; each rendered line gets its ratio of
text to tags. Text inside links, before the headline, in capitals throughout, or recurring on other pages of
the site counts as markup; headings and list items take the ratio of the text they stand beside. The ratios are smoothed with
a Gaussian that stays inside one container, and two-means threshold clustering splits each page into content
and other regions. The regions of all pages then teach what the form of a line (names and numbers masked)
and its place (site, container, element) say, and each line is judged by what the other lines of its form
and place are. An exact check follows: lines in the form of the corpus's own headlines are teasers, lines
that say what they are (copyright, consent, sharing, dates of publication) go, messages in place of content
stay.

Plan: one map over the pages turns each line into a few numbers, so HTML and text are read once and never
shuffled; supports and evidence are partial aggregations joined back to those rows.

Defined results: pages without text give no rows; blank lines are never listed; broken or missing HTML
only removes the evidence of the regions; rows that agree in id, title, text and HTML are one page, other
rows with one id are judged each by itself. Whole texts and whole HTML are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.urls import domain_of
from lodestack.llm.residue import is_residue_line
from lodestack.session import cut

SIGMA = 0.7
#: A line that so many pages of a site hold is the site's, not the page's.
RECURS = 3
#: A form that so many pages carry as their headline is a headline's form.
HEADLINES = 3
#: Weights of the place and of the line's own region beside the evidence of its form, and pseudo-counts.
PLACE, OWN, FORM_COUNT, PLACE_COUNT = 0.4, 0.3, 2.0, 8.0
#: Lines whose form a worker remembers, as sites repeat theirs.
CACHED_LINES = 100_000
#: Elements whose text is never rendered, elements inside a line, links, and elements that hold single lines (fixed values).
SILENT = {"script", "style", "noscript", "template", "svg", "head", "title"}
INLINE = {"a", "b", "i", "em", "strong", "span", "u", "small", "sup", "sub", "font", "code", "abbr", "cite", "q", "s", "mark", "time", "label"}
LINKS = {"a", "button", "option"}
LEAVES = {"p", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "tbody", "thead", "br", "hr"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PLAIN, HEADING, ITEM, LINK = range(4)
#: Bits of a line: the page's headline, before it, named furniture, a message in place of content, first of its key in the page, marked as a heading in the text itself.
HEADLINE, BEFORE, NAMED, MESSAGE, FIRST, MARKED = 1, 2, 4, 8, 16, 32


class LineEvents(HTMLParser):
    """Turns parser events into rendered lines: words, tags, characters inside links, container, element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, str, str]] = []
        self._text: list[str] = []
        self._tags = 0
        self._link = 0
        self._in_link = 0
        self._quiet = 0
        self._leaf = ""
        self._open: list[tuple[str, str]] = []

    def _close(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            place = next((name for _, name in reversed(self._open) if name != "div"), "")
            self.lines.append((text, self._tags, self._link, place, self._leaf))
            self._tags, self._link = 0, 0
        self._text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._close()
        self._tags += 1
        if tag in SILENT:
            self._quiet += 1
        elif tag in LINKS or any(k == "onclick" for k, _ in attrs):
            if tag == "a":
                self._close()
                self._leaf = tag
            self._in_link += 1
        if tag in LEAVES:
            self._leaf = tag
        elif tag not in INLINE and tag not in SILENT and tag not in VOID:
            named = [f"{k}={v}" for k, v in attrs if k in ("class", "id") and v]
            self._open.append((tag, " ".join([tag, *named])))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._close()
        self._tags += 1
        if tag in LEAVES:
            self._leaf = tag

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in SILENT:
            self._quiet = max(0, self._quiet - 1)
        elif self._in_link and (tag in LINKS or tag == "span"):
            self._in_link -= 1
        if tag not in INLINE:
            self._close()
            if tag not in LEAVES:
                for i in range(len(self._open) - 1, -1, -1):
                    if self._open[i][0] == tag:
                        del self._open[i:]
                        break

    def handle_data(self, data: str) -> None:
        if self._quiet:
            return
        self._text.append(data)
        if self._in_link:
            self._link += len(data.strip())

    def done(self) -> list[tuple[str, int, int, str, str]]:
        self.close()
        self._close()
        return self.lines


def rendered_lines(html: str) -> list[tuple[str, int, int, str, str]]:
    p = LineEvents()
    p.feed(html)
    return p.done()


_WORD = re.compile(r"\w+")


@lru_cache(maxsize=CACHED_LINES)
def _squash(s: str) -> str:
    return " ".join(_WORD.findall(s.casefold()))


_PART = re.compile(r"[^\W\d_]+|\d+|[,.:;!?()|]")
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.){2,}")
_STOP = re.compile(r"[.!?…]\s+(?=[“„«\"\d]|[^\W\d_a-zß-ÿ])")
_FIXED = 8


@lru_cache(maxsize=CACHED_LINES)
def form(line: str) -> str:
    """The line's opening up to its first sentence end, with names (capital words) and numbers masked.

    Where too few letters would stay to tell forms apart, the first word stays as it is.
    """
    s = _DOTTED.sub("X ", line)
    m = _STOP.search(s)
    s = s[: m.start()] if m else s
    out: list[str] = []
    kept, first = 0, ""
    for w in _PART.findall(s):
        c = w[0]
        if c.isdigit():
            t = "#"
        elif not c.isalpha():
            t = w
        else:
            first = first or w.lower()
            t = "X" if c.isupper() else w
            kept += 0 if c.isupper() else len(w)
        if not (out and t in "X#" and out[-1] == t):
            out.append(t)
    while out and out[-1] in ".!":
        out.pop()
    return " ".join(out) if kept >= _FIXED else f"{first}: {' '.join(out)}"


def smoothed(ratios: np.ndarray, groups: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing of the lines in order; lines of another group do not take part."""
    num, den = ratios.astype(float), np.ones(len(ratios))
    total = num.copy()
    for o in range(1, min(int(np.ceil(3 * sigma)), len(ratios) - 1) + 1):
        w = np.exp(-(o * o) / (2 * sigma * sigma)) * (groups[o:] == groups[:-o])
        total[o:] += w * num[:-o]
        total[:-o] += w * num[o:]
        den[o:] += w
        den[:-o] += w
    return total / den


def content_regions(smooth: np.ndarray, page: np.ndarray) -> np.ndarray:
    """True where a smoothed ratio belongs to the upper of its page's two clusters (two-means on the logarithm).

    `page` numbers the pages of the lines in order, from 0; a page whose lines are all alike is content, if it has any text of its own.
    """
    if not len(smooth):
        return np.zeros(0, dtype=bool)
    x = np.log1p(smooth)
    starts = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1])))
    at = np.cumsum(np.concatenate(([True], page[1:] != page[:-1]))) - 1
    low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    flat = (high - low < 0.2) & (high > 0)
    n = np.diff(np.append(starts, len(x)))
    whole = np.add.reduceat(x, starts)
    for _ in range(12):
        up = x > ((low + high) / 2)[at]
        k = np.add.reduceat(up.astype(float), starts)
        s = np.add.reduceat(np.where(up, x, 0.0), starts)
        low, high = np.where(k < n, (whole - s) / np.maximum(n - k, 1), low), np.where(k > 0, s / np.maximum(k, 1), high)
    return (x > ((low + high) / 2)[at]) | flat[at]


#: Lines that say themselves what they are, without end marks (fixed patterns).
FURNITURE = re.compile(
    r"(?i)^\W*(?:"
    # consent
    r"(?:we|this (?:website|site|page)|.{1,80}) (?:uses?|is using) cookies\b.*|cookie (?:choices|settings|preferences|notice|policy)\b.*|(?:accept|reject) all(?: cookies)?|we and \d+ partners\b.*"
    # paths
    r"|(?:home(?:page)?|start|you are here|startseite|accueil|inicio)\s*[:>»/›]\s*.{2,160}"
    # dates, credits, reactions
    r"|(?:posted|published|updated|last (?:updated|modified|changed)) (?:on |by |at )?\W*\d{1,4}[./-]\d{1,2}[./-]\d{1,4}.{0,80}|reading time: ?\d+.*|\d+ min(?:ute)?s? read.*"
    r"|[^.:;]{3,60}, (?:staff writer|staff reporter|correspondent)|[^.!?]{3,60} commented: .*|\d+ comments?|leave a comment.{0,40}|comments? (?:are )?closed"
    # sharing, sign-up
    r"|(?:share|send|email|e-mail|print|forward|recommend|tweet) (?:this|the) (?:page|profile|story|article|text)\b.{0,60}|share: .{3,60}|share on .{3,60}|follow us.{0,60}|subscribe to (?:our|the|this)\b.{0,90}|sign up for\b.{0,90}"
    # legal notices, adverts
    r"|.{0,30}all rights reserved|©.*|copyright\b.{0,90}|registered office: .*|advertisement|sponsored(?: content| link)?|anzeige|publicité|publicidad|.{5,140}\b\d+ ?(?:percent|%) off\b.*"
    r"|.{2,90}, \d+ (?:\w+ ){1,3}(?:road|street|avenue|lane|way|square), .{2,60}"
    # headings of lists of other pages, footers
    r"|(?:you (?:may|might) also like|related (?:stories|articles|pages|posts|profiles|news)|most read|most popular|recommended (?:profiles|stories|for you|pages)|see also|trending(?: now)?)"
    r"|imprint(?:\W+\w+){0,6}|accessibility statement|sitemap|back to (?:top|start|home)|skip to (?:main )?content|terms(?: of use)?|privacy(?: policy| notice)?|contact us"
    r")\W*$"
)
#: Quotes of shares: capitals and numbers by turns.
TICKER = re.compile(r"^\W*(?:[A-Z]{3,5} [+-]?\d+(?:\.\d+)?\W*){2,}$")
_ITEM = re.compile(r"\s*(?:[-*•]\s+|\d{1,2}[.)]\s+)")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_WAY_BACK = re.compile(r"(?i)^(?:go )?back(?: to (?:the )?(?:start|home|homepage|front page))?\W*$")
_MARKS = " \t\r.!…»|·"
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=CACHED_LINES)
def furniture(plain: str) -> bool:
    return bool(FURNITURE.match(plain) or TICKER.match(plain))


def page_features(text: str, html: str | None, title: str | None, site: str | None) -> list[tuple[int, int, int, int, int, float, int, int]]:
    """(line_no, key, form, place, group, ratio, kind, bits) of each line that is not blank.

    key is what must recur on the site for the line to be the site's: its form, or for whole sentences and
    headings and items its letters. group tells the lines between which ratios are smoothed.
    """
    lines = text.split("\n")
    plain = [" ".join(x.split()) for x in lines]
    keys = [_squash(p) for p in plain]
    rendered = rendered_lines(html) if html else []
    seen: dict[str, list[int]] = {}
    for j, r in enumerate(rendered):
        seen.setdefault(_squash(r[0]), []).append(j)
    name = _squash(title or "")
    head = next((i for i, k in enumerate(keys) if k and k == name), None)
    if head is None:
        head = next((i for i, x in enumerate(lines) if x.lstrip().startswith("# ")), None)
    if head is None and name:
        head = next((i for i, k in enumerate(keys) if len(k) > 20 and (name.startswith(k) or k.startswith(name))), None)
    message = [bool(p) and is_residue_line(p) for p in plain]
    if any(m and p.isdigit() for m, p in zip(message, plain)):  # a bare status code comes with a way back
        message = [m or bool(_WAY_BACK.match(p)) for m, p in zip(message, plain)]
    start = head if head is not None else next((i for i, p in enumerate(plain) if message[i] or len(p) >= 45 and _SENTENCE.search(p)), len(plain))
    site = site or ""
    out, met, last = [], set(), -1
    for i, p in enumerate(plain):
        if not p:
            continue
        _, tags, link, place, leaf = "", 2, 0, "", ""
        if at := seen.get(keys[i]):
            # words that the page shows several times: the next place after the last line's
            last = at[bisect_right(at, last) % len(at)]
            _, tags, link, place, leaf = rendered[last]
        size = len(p)
        if link >= 0.8 * size:
            kind = LINK
        elif leaf in HEADINGS or p[0] == "#":
            kind = HEADING
        elif leaf == "li" or _ITEM.match(lines[i]):
            kind = ITEM
        else:
            kind = PLAIN
        bare = p.rstrip(_MARKS)
        shape = form(p)
        bits = (HEADLINE if i == head else 0) | (BEFORE if i < start else 0) | (NAMED if furniture(bare) else 0) | (MESSAGE if message[i] else 0) | (MARKED if p[0] == "#" and i >= start else 0)
        whole = kind in (HEADING, ITEM) or _SENTENCE.search(p)
        letters = "".join(_LETTERS.findall(p.lower())) if whole else ""
        key = xxhash.xxh64_intdigest(f"{site}\n{letters or shape}")
        if key not in met:
            met.add(key)
            bits |= FIRST
        loud = kind == PLAIN and p.isupper() and len(_WORD.findall(p)) > 1
        ratio = 0.0 if kind == LINK or loud or bits & BEFORE else max(size - link, 0) / max(tags, 1)
        group = xxhash.xxh32_intdigest(place + "!" * loud)
        out.append((i + 1, key, xxhash.xxh64_intdigest(f"{shape}\n" if kind == LINK else shape), xxhash.xxh64_intdigest(f"{site}\n{place}\n{leaf}\n{kind}{loud}"), group, ratio, kind, bits))
    return out


LINES = "page long, id long, line_no int, key long, form long, place long, grp int, ratio float, kind int, bits int"
JUDGED = "page long, id long, line_no int, form long, place long, content boolean, bits int"


def _signed(xs: list[int], bits: int) -> np.ndarray:
    return np.array(xs, dtype=f"uint{bits}").view(f"int{bits}")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, ids, rows = [], [], []
        for page, row, title, text, html, site in zip(*(batch.column(i).to_pylist() for i in range(6))):
            got = page_features(text, html, title, site)
            rows.extend(got)
            pages.extend([page] * len(got))
            ids.extend([row] * len(got))
        no, key, shape, place, group, ratio, kind, bits = zip(*rows) if rows else [()] * 8
        cols = [pa.array(pages, pa.int64()), pa.array(ids, pa.int64()), pa.array(no, pa.int32()), *(pa.array(_signed(x, 64), pa.int64()) for x in (key, shape, place)), pa.array(_signed(group, 32), pa.int32()), pa.array(ratio, pa.float32()), pa.array(kind, pa.int32()), pa.array(bits, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in LINES.split(", ")])


def line_regions(page: np.ndarray, group: np.ndarray, ratio: np.ndarray, kind: np.ndarray, bits: np.ndarray, recurs: np.ndarray) -> np.ndarray:
    """Whether each line lies in a content region; lines come in page order, `page` numbers the pages from 0."""
    site_own = recurs & (kind == PLAIN)
    v = np.where(site_own, 0.0, ratio)
    # headings and items take the ratio of the text they stand beside in their container
    lend = (kind == HEADING) | (kind == ITEM)
    if lend.any():
        lent = np.zeros(len(v))
        for order in (range(len(v)), range(len(v) - 1, -1, -1)):
            last: dict[int, float] = {}
            at = -1
            for i in order:
                if page[i] != at:
                    last, at = {}, page[i]
                if lend[i]:
                    lent[i] = max(lent[i], last.get(group[i], 0.0))
                elif kind[i] == PLAIN and not site_own[i]:
                    last[group[i]] = v[i]
        v = np.where(lend & (bits & BEFORE == 0), lent, v)
    top = np.zeros(int(page[-1]) + 1 if len(page) else 0)
    np.maximum.at(top, page, v)
    v = np.where(bits & HEADLINE != 0, top[page], v)
    apart = (page.astype(np.int64) << 34) ^ (group.astype(np.int64) << 2) ^ (2 * site_own) ^ (bits & BEFORE != 0)
    return content_regions(smoothed(v, apart), page)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        n = np.diff(lists.offsets.to_numpy())
        page = np.repeat(np.arange(len(n)), n)
        f = {x.name: y for x, y in zip(lists.type.value_type, lists.flatten().flatten())}
        no = f["line_no"].to_numpy()
        order = np.lexsort((no, page))
        again = np.concatenate(([False], (np.diff(page[order]) == 0) & (np.diff(no[order]) == 0)))[: len(order)]
        order = order[~again]  # rows of a page that is there twice
        take = lambda c: f[c].to_numpy(zero_copy_only=False)[order]
        page, bits, recurs = page[order], take("bits"), take("recurs")
        content = line_regions(page, take("grp"), take("ratio").astype(float), take("kind"), bits, recurs)
        place = take("place") * 2 + recurs
        held = lambda i: batch.column(i).to_numpy(zero_copy_only=False)[page]
        cols = [pa.array(held(0), pa.int64()), pa.array(held(1), pa.int64()), pa.array(no[order], pa.int32()), pa.array(take("form"), pa.int64()), pa.array(place, pa.int64()), pa.array(content, pa.bool_()), pa.array(bits, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in JUDGED.split(", ")])


def _source(pages: DataFrame) -> DataFrame:
    p = pages.select(F.col("id").cast("long").alias("id"), "title", F.col("text_content").cast("string").alias("text_content"), "raw_html", domain_of(F.col("normalized_url")).alias("site"))
    return p.select(F.xxhash64("id", "title", "text_content", "raw_html").alias("page"), "id", "title", "text_content", "raw_html", "site")


def _judged_lines(source: DataFrame) -> DataFrame:
    """page, id, line_no of the lines that are not body."""
    lines = cut(source.filter("id is not null and trim(text_content) <> ''").mapInArrow(_features, LINES))
    recurring = lines.filter(f"bits & {FIRST} <> 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RECURS).select("key", F.lit(True).alias("recurs"))
    known = lines.join(recurring, "key", "left").withColumn("recurs", F.coalesce("recurs", F.lit(False)))
    per_page = known.groupBy("page", "id").agg(F.collect_list(F.struct("line_no", "form", "place", "grp", "ratio", "kind", "bits", "recurs")).alias("l"))
    told = cut(per_page.mapInArrow(_regions, JUDGED))
    headline = F.col("bits").bitwiseAND(HEADLINE) != 0
    # what the regions say of each form and place; titles only tell which forms headlines have
    value = F.when(F.col("content"), 0.9).otherwise(0.1)
    forms = told.groupBy("form").agg(F.sum(F.when(~headline, value)).alias("fs"), F.count(F.when(~headline, 1)).alias("fn"), F.count(F.when(headline, 1)).alias("heads")).filter("fn + heads > 1")
    places = told.groupBy("place").agg(F.sum(value).alias("ps"), F.count(F.lit(1)).alias("pn")).filter("pn > 1")
    x = told.filter(~headline & (F.col("bits").bitwiseAND(MESSAGE) == 0)).join(forms, "form", "left").join(places, "place", "left")
    others = lambda s, n, a: (F.coalesce(F.col(s) - value, F.lit(0.0)) + 0.5 * a) / (F.greatest(F.coalesce(F.col(n) - 1, F.lit(0)), F.lit(0)) + a)
    odds = lambda q: F.log(F.least(F.greatest(q, F.lit(0.002)), F.lit(0.998)) / (1 - F.least(F.greatest(q, F.lit(0.002)), F.lit(0.998))))
    score = odds(others("fs", "fn", FORM_COUNT)) + PLACE * odds(others("ps", "pn", PLACE_COUNT)) + F.when(F.col("content"), OWN).otherwise(-OWN)
    body = F.when(F.col("bits").bitwiseAND(BEFORE) != 0, F.col("content")).otherwise((score > 0) | (F.col("bits").bitwiseAND(MARKED) != 0))
    checked = (F.col("bits").bitwiseAND(NAMED) != 0) | (F.coalesce("heads", F.lit(0)) >= HEADLINES)
    return x.filter(~body | checked).select("page", "id", "line_no")


def furniture_lines(pages: DataFrame) -> DataFrame:
    """id, line_no of the lines that are not body."""
    return _judged_lines(_source(pages)).select("id", "line_no")


def page_bodies(pages: DataFrame) -> DataFrame:
    """id, body of every page; null text gives null. Only numbers of lines are joined with the texts."""
    source = _source(pages)
    gone = _judged_lines(source).groupBy("page").agg(F.collect_set("line_no").alias("gone"))
    kept = F.expr("array_join(filter(split(text_content, '\\n', -1), (x, i) -> gone is null or not array_contains(gone, i + 1)), '\\n')")
    return source.select("page", "id", "text_content").join(gone, "page", "left").select("id", F.when(F.col("text_content") == "", "").otherwise(kept).alias("body"))
