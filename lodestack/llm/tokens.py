"""Problem 6: token ids of every text under a public byte-level BPE vocabulary.

Method: a pair occurrence index. The distinct pre-tokens of a block of rows become one long symbol
array; every mergeable adjacent pair is indexed by its rank with all its positions; ranks are taken
from a heap in ascending order, all occurrences of a rank are merged at once, and the pairs to the
left and right of each merge are put back into the index. The per-row work is then a table look-up.

Defined results: null and empty texts give an empty list; strings that look like special tokens are
ordinary text; every input row gives one output row, repeated rows included.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
#: Pre-token pattern of the public vocabulary (fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text handled as one block; bounds a worker's memory.
BLOCK_CHARS = 24_000_000
#: Distinct pre-tokens a worker remembers between blocks before it starts afresh.
CACHE_WORDS = 1_500_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class PairIndexBpe:
    """Byte-level BPE over many words at once through a rank -> positions index."""

    def __init__(self, vocab_path: str):
        with open(vocab_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.byte_ids = np.array([vocab[c] for c in _byte_symbols()], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.left, self.right = left, right
        keys = (left << 20) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order
        # a dense row per left symbol narrows the search to a few entries
        self.words: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.words = {}
        self.start = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, -1 where the pair never merges."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and each word's number of ids."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        sym = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        n = len(sym)
        ends = np.cumsum(sizes)
        nxt = np.arange(1, n + 1, dtype=np.int64)
        nxt[ends[sizes > 0] - 1] = -1
        prv = np.arange(-1, n - 1, dtype=np.int64)
        starts = (ends - sizes)[sizes > 0]
        prv[starts] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(positions: np.ndarray, ranks: np.ndarray) -> None:
            ok = ranks >= 0
            if not ok.all():
                positions, ranks = positions[ok], ranks[ok]
            if not len(ranks):
                return
            if len(ranks) > 1:
                by = np.argsort(ranks, kind="stable")
                positions, ranks = positions[by], ranks[by]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                firsts = [0, *cuts.tolist()]
                stops = [*firsts[1:], len(ranks)]
            else:
                firsts, stops = [0], [1]
            for i, (f, t) in zip(ranks[firsts].tolist(), zip(firsts, stops)):
                held = index.get(i)
                if held is None:
                    index[i] = [positions[f:t]]
                    heapq.heappush(heap, i)
                else:
                    held.append(positions[f:t])

        at = np.flatnonzero(nxt >= 0)
        put(at, self._ranks(sym[at], sym[at + 1]))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            pos = pos[sym[pos] == a]
            q = nxt[pos]
            ok = (q >= 0) & (sym[q] == b)
            if not ok.all():
                pos, q = pos[ok], q[ok]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # aaa: occurrences overlap, the left one wins
                keep, taken = [], -1
                for i, (p, r) in enumerate(zip(pos.tolist(), q.tolist())):
                    if p != taken:
                        keep.append(i)
                        taken = r
                pos, q = pos[keep], q[keep]
            after = nxt[q]
            sym[pos] = self.merged[rank]
            sym[q] = -1
            nxt[pos] = after
            has = after >= 0
            prv[after[has]] = pos[has]
            before = prv[pos]
            lp = before[before >= 0]
            new_pos = np.concatenate((lp, pos[has]))
            if len(new_pos):
                put(new_pos, self._ranks(sym[new_pos], sym[nxt[new_pos]]))
        kept = sym >= 0
        word_of = np.repeat(np.arange(len(words)), sizes)
        counts = np.bincount(word_of[kept], minlength=len(words)).astype(np.int64)
        return sym[kept].astype(np.int32), counts

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and each text's number of ids."""
        import regex

        find = _pattern().findall
        if len(self.words) > CACHE_WORDS:
            self._reset()
        words = self.words
        known = len(words)
        parts, per_text = [], np.zeros(len(texts), dtype=np.int64)
        fresh = words.setdefault
        for i, t in enumerate(texts):
            if t:
                toks = find(t)
                per_text[i] = len(toks)
                parts.append(np.fromiter([fresh(w, len(words)) for w in toks], dtype=np.int32, count=len(toks)))
        del regex
        if len(words) > known:
            new = list(words)[known:] if known == 0 else [w for w, _ in zip(reversed(words), range(len(words) - known))][::-1]
            flat, counts = self.encode_words(new)
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(counts)))
            self.flat = np.concatenate((self.flat, flat))
        if not parts:
            return np.zeros(0, dtype=np.int32), per_text
        codes = np.concatenate(parts)
        begin = self.start[codes]
        size = self.start[codes + 1] - begin
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_text)))]
        return flat, np.diff(upto)


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PRETOKEN)


@lru_cache(maxsize=2)
def encoder(vocab_path: str) -> PairIndexBpe:
    return PairIndexBpe(vocab_path)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Gather Arrow batches into blocks of bounded text, without splitting a row."""
    held, size = [], 0
    for batch in batches:
        start = 0
        text = batch.column(1)
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0))
        while start < len(lengths):
            room = np.searchsorted(np.cumsum(lengths[start:]), max(limit - size, 0), side="right")
            take = max(1, int(room)) if not held else int(room)
            if take:
                held.append(batch.slice(start, take))
                size += int(lengths[start : start + take].sum())
                start += take
            if size >= limit or start < len(lengths):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str = DEFAULT_VOCAB, counts_only: bool = False) -> DataFrame:
    """One row per input row: the id and `ids` (array<int>), or `n_tokens` (long) with counts_only.

    A map-only plan: no shuffle, one Arrow pass over the id and text columns.
    """
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    id_type = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab_path)
        for block in _blocks(batches, BLOCK_CHARS):
            texts = block.column(1).to_pylist()
            flat, sizes = bpe.encode_texts(texts)
            ids = block.column(0).combine_chunks()
            if counts_only:
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes)], names=[id_col, "n_tokens"])
                continue
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            # results leave in slices, so that no single Arrow message grows with the block
            step = 2000
            for s in range(0, len(sizes), step):
                e = min(s + step, len(sizes))
                lists = pa.ListArray.from_arrays(pa.array((offsets[s : e + 1] - offsets[s]).astype(np.int32)), pa.array(flat[offsets[s] : offsets[e]]))
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), lists], names=[id_col, "ids"])

    value = "n_tokens long" if counts_only else "ids array<int>"
    return src.mapInArrow(run, f"`{id_col}` {id_type}, {value}")
