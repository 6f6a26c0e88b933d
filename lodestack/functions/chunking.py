"""Heading-aware overlapping chunks. Packing depends on what was packed before, so it runs in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import chunk_normal
from lodestack.settings import DEFAULTS, Settings

_HEADING = re.compile(r"#{1,6}\s+(.*)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: A carried tail this short says nothing and is left behind.
LEAST_CARRY = 60
CHUNK_TYPE = "array<struct<ordinal int, text string, char_start int, char_end int, heading string>>"


def blocks(text: str) -> list[tuple[bool, str]]:
    """(is heading, content) of a normalised text; the lines of a paragraph are joined by blanks."""
    out: list[tuple[bool, str]] = []
    for group in re.split(r"\n\n+", text):
        run: list[str] = []
        for line in [*group.split("\n"), None]:
            head = _HEADING.fullmatch(line) if line else None
            if line and not head:
                run.append(line)
                continue
            if run:
                out.append((False, " ".join(run).strip()))
                run = []
            if head:
                out.append((True, head.group(1).strip()))
    return out


def sentence_pieces(block: str, size: int) -> list[str]:
    """A long paragraph as pieces of whole sentences; a sentence beyond the size is cut at it."""
    done, open_ = [], ""
    for s in _SENTENCE.split(block):
        if open_ and len(open_) + 1 + len(s) > size:
            done.append(open_)
            open_ = ""
        if len(s) > size:
            done += [s[i : i + size] for i in range(0, len(s), size)]
        else:
            open_ = f"{open_} {s}".strip()
    return [p for p in (x.strip() for x in [*done, open_]) if p]


class Packer:
    """Packs blocks into chunks; offsets point at the first block that was not carried over."""

    def __init__(self, source: str, size: int, overlap: int):
        self.source, self.size, self.overlap = source, size, overlap
        self.chunks: list[dict] = []
        self.held: list[str] = []
        self.used = self.start = self.seek = 0
        self.label = ""

    def _emit(self, body: str) -> None:
        self.chunks.append({"ordinal": len(self.chunks), "text": body, "char_start": self.start, "char_end": self.start + len(body), "heading": self.label})

    def close(self) -> None:
        body = "\n\n".join(self.held).strip()
        if body:
            self._emit(body)
        self.held, self.used = [], 0

    def _hold(self, block: str) -> None:
        self.held.append(block)
        self.used += len(block) + 2

    def add(self, block: str, heading: bool) -> None:
        if heading:
            if self.used >= self.size // 2:
                self.close()
            if not self.held:
                self.label = block
        elif len(block) > self.size:
            self.close()
            for piece in sentence_pieces(block, self.size):
                at = self.source.find(piece, self.seek)
                if at >= 0:
                    self.start, self.seek = at, at + len(piece)
                self._emit(piece)
            return
        at = self.source.find(block, self.seek)
        if self.held and self.used + len(block) + 2 > self.size:
            self.close()
            tail = self.chunks[-1]["text"][-self.overlap :] if self.overlap else ""
            self.start = at if at >= 0 else self.seek
            if len(tail) > LEAST_CARRY:
                self._hold(tail)
        elif at >= 0:
            if not self.held:
                self.start = at
            self.seek = at + len(block)
        self._hold(block)


def chunk_normalised(text: str | None, size: int, overlap: int) -> list[dict]:
    if not text:
        return []
    p = Packer(text, size, overlap)
    for heading, block in blocks(text):
        if block or heading:
            p.add(block, heading)
    p.close()
    return p.chunks


def chunk_text(text: Column, s: Settings = DEFAULTS) -> Column:
    """The chunks of a text column; null and empty texts give an empty array."""
    size, overlap = s.chunk_size, s.chunk_overlap

    @F.arrow_udf(CHUNK_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        t = pa.list_(pa.struct([("ordinal", pa.int32()), ("text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("heading", pa.string())]))
        return pa.array([chunk_normalised(x, size, overlap) for x in texts.to_pylist()], t)

    return run(chunk_normal(text))
