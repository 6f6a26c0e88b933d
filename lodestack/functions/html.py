"""HTML parsing on the standard library's event parser, in Arrow batches.

One pass over a page gives its text-bearing elements, metadata and anchors. Broken markup is repaired by
implied end tags, not by a full tree builder, so deeply malformed pages may differ from a browser's view.
Null HTML gives empty results.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

#: Elements whose whole content is chrome, and elements whose text is collected (fixed values).
CHROME = frozenset("script style noscript nav footer header aside form iframe svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COLLECTED = HEADINGS | frozenset("p li td th blockquote dd dt strong b em a figcaption summary".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
META_NAMES = frozenset(("description", "author", "keywords", "robots"))
LONGEST_ELEMENT = 400
#: What a start tag ends where its end tag was left out (fixed values).
_BLOCKS = "p div ul ol dl table h1 h2 h3 h4 h5 h6 section article header footer nav aside form blockquote pre hr main figure".split()
IMPLIED = {**{b: {"p"} for b in _BLOCKS}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "a": {"a"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dd": {"dl"}, "dt": {"dl"}}


class PageEvents(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.elements: list[tuple[str, list[str]]] = []
        self.anchors: list[tuple[str, list[str]]] = []
        self._stack: list[tuple[str, list[str] | None, list[str] | None]] = []
        self._chrome = 0
        self._title: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "meta":
            self._read_meta(a)
        elif tag == "link" and "canonical" in (a.get("rel") or "").lower().split() and a.get("href"):
            self.meta.setdefault("canonical", a["href"].strip())
        elif tag == "html" and a.get("lang"):
            self.meta.setdefault("lang", a["lang"].strip())
        elif tag == "title" and "title" not in self.meta and self._title is None:
            self._title = []
        if tag in VOID:
            return
        self._imply(tag)
        collected = anchor = None
        if tag in CHROME:
            self._chrome += 1
        elif tag in COLLECTED and not self._chrome:
            collected = []
            self.elements.append((tag, collected))
        if tag == "a" and a.get("href") is not None:
            anchor = []
            self.anchors.append((a["href"].strip(), anchor))
        self._stack.append((tag, collected, anchor))

    def _imply(self, tag: str) -> None:
        ends = IMPLIED.get(tag)
        if not ends:
            return
        stop = _SCOPES.get(tag, set())
        for i in range(len(self._stack) - 1, -1, -1):
            name = self._stack[i][0]
            if name in ends:
                self._pop_to(i)
                if tag not in ("tr", "li", "dd", "dt", "td", "th"):
                    return
            elif name in stop or name in ("body", "html", "div", "table", "section", "article") and tag not in _SCOPES:
                return

    def _pop_to(self, i: int) -> None:
        for name, _, _ in self._stack[i:]:
            if name in CHROME:
                self._chrome -= 1
        del self._stack[i:]

    def _read_meta(self, a: dict) -> None:
        name, content = a.get("name") or a.get("property") or a.get("itemprop"), a.get("content")
        if name and content:
            key = name.strip().lower()
            if key in META_NAMES or key.startswith(("og:", "twitter:")):
                self.meta[key] = content.strip()

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self._title is not None:
            text = "".join(self._title).strip()
            if text:
                self.meta["title"] = text
            self._title = None
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                self._pop_to(i)
                return

    def handle_data(self, data: str) -> None:
        if self._title is not None:
            self._title.append(data)
        text = data.strip()
        if not text:
            return
        for _, collected, anchor in self._stack:
            if collected is not None and not self._chrome:
                collected.append(text)
            if anchor is not None:
                anchor.append(text)


def parse(html: str | None) -> PageEvents:
    p = PageEvents()
    p.feed(html or "")
    p.close()
    return p


def walk_text(page: PageEvents) -> str:
    """The page's elements as lines: `#` by heading level, `- ` for items, repeats and containments dropped."""
    lines: list[str] = []
    seen: set[str] = set()
    for tag, parts in page.elements:
        text = " ".join(parts)
        if not text or len(text) > LONGEST_ELEMENT or text in seen or (lines and (text in lines[-1] or lines[-1] in text)):
            continue
        seen.add(text)
        mark = "#" * int(tag[1]) + " " if tag in HEADINGS else "- " if tag == "li" else ""
        lines.append(mark + text)
    return "\n\n".join(lines)


def choose_extraction(main: str, walked: str) -> str:
    """The main-content extractor's text unless it plainly lost content to the element walk."""
    if not main or not walked:
        return main or walked
    pruned = len(main) < 200 and len(walked) > len(main) or len(main) >= 200 and len(main) < 0.5 * len(walked)
    return walked if pruned else main


def extraction_method(chosen: str, main: str, walked: str) -> str:
    if not chosen:
        return "none"
    return "dom" if chosen == walked and chosen != main else "main"


PAGE_TYPE = StructType([*(StructField(n, StringType()) for n in ("text", "title", "description")), StructField("meta", MapType(StringType(), StringType())), StructField("method", StringType())])
ANCHOR_TYPE = ArrayType(StructType([StructField("href", StringType()), StructField("text", StringType()), StructField("pos", IntegerType())]))


def page_extractor(main_content: Callable[[str], str] | None = None) -> Callable[[Column], Column]:
    """A function of an HTML column giving text, title, description, meta and method.

    `main_content` plugs in another extractor of main content; without one the element walk decides.
    """

    @F.arrow_udf(PAGE_TYPE)
    def run(pages: pa.Array) -> pa.Array:
        rows = []
        for html in pages.to_pylist():
            p = parse(html)
            walked = walk_text(p)
            main = (main_content(html or "") or "") if main_content else ""
            text = choose_extraction(main, walked)
            m = p.meta
            rows.append({"text": text.strip(), "title": (m.get("og:title") or m.get("title") or "")[:1000], "description": (m.get("description") or m.get("og:description") or "")[:2000], "meta": list(m.items()), "method": extraction_method(text, main, walked)})
        t = pa.struct([("text", pa.string()), ("title", pa.string()), ("description", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("method", pa.string())])
        return pa.array(rows, t)

    return run


@F.arrow_udf(ANCHOR_TYPE)
def _anchors(pages: pa.Array, bases: pa.Array) -> pa.Array:
    out = []
    for html, base in zip(pages.to_pylist(), bases.to_pylist()):
        rows = []
        for i, (href, parts) in enumerate(parse(html).anchors if html else ()):
            if not href or href.startswith(("#", "mailto:", "tel:", "javascript:")):
                continue
            try:
                rows.append({"href": urljoin(base or "", href), "text": " ".join(parts), "pos": i})
            except ValueError:
                continue
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("href", pa.string()), ("text", pa.string()), ("pos", pa.int32())])))


def anchors(html: Column, base_url: Column) -> Column:
    """The page's links made absolute, with their text and position; page-internal and non-web links left out."""
    return _anchors(html, base_url)


def decode_bytes(body: bytes | None, content_type: str | None = "") -> str:
    """Page bytes as text: the declared charset, else a byte mark or meta charset, else UTF-8 with replacement."""
    raw = body or b""
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I) or re.search(rb"<meta[^>]{0,200}charset\s*=\s*[\"']?([\w.:-]+)", raw[:4096], re.I)
    names = [m.group(1) if isinstance(m.group(1), str) else m.group(1).decode("ascii", "replace")] if m else []
    if raw.startswith(codecs.BOM_UTF8):
        names.insert(0, "utf-8-sig")
    elif raw.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        names.insert(0, "utf-16")
    for n in names:
        try:
            return raw.decode(n, "replace")
        except LookupError:
            continue
    return raw.decode("utf-8", "replace")


@F.arrow_udf(StringType())
def decode_html(bodies: pa.Array, content_types: pa.Array) -> pa.Array:
    return pa.array([None if b is None else decode_bytes(b, t) for b, t in zip(bodies.to_pylist(), content_types.to_pylist())], pa.string())
