"""Problem 6 against the public library and an exact round trip."""

import random

import numpy as np
import pytest

from lodestack.llm import tokens as t

TEXTS = [None, "", " ", "  \n\n ", "Hello world", "it's we'll they've I'd", "<|endoftext|> plain", "naïve café Zoë Łukasz", "日本語のテキスト と かな", "🙂👩‍👩‍👧‍👦 emoji", "a" * 3000, "aaa aaaa aaaaa", "x = {'a': 1};\treturn  x;", "١٢٣ ٤٥٦ 1234567890", " nbsp em", "é combining", "مرحبا بالعالم", "ab" * 40_000, "\x00\x01\x1f ctrl"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(t.DEFAULT_VOCAB)
    lib.encode_special_tokens = True
    return lib


def test_against_library(library):
    rnd = random.Random(2)
    words = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzßé ,.'") for _ in range(rnd.randrange(1, 12))) for _ in range(3000))
    texts = [*TEXTS, words, *["".join(rnd.choice("ab c\n'sé") for _ in range(80)) for _ in range(300)]]
    flat, sizes = t.PairIndexBpe(t.DEFAULT_VOCAB).encode_texts(texts)
    ends = np.cumsum(sizes)
    want = library.encode_batch([x or "" for x in texts], add_special_tokens=False)
    for i, w in enumerate(want):
        assert flat[ends[i] - sizes[i] : ends[i]].tolist() == w.ids, repr(texts[i])[:80]


def test_cache_reset_and_reuse(library, monkeypatch):
    monkeypatch.setattr(t, "CACHE_WORDS", 3)
    bpe = t.PairIndexBpe(t.DEFAULT_VOCAB)
    for text in ("one two three four five", "six seven one two", "one"):
        assert bpe.encode_texts([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_operator_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_CHARS", 500)
    rows = [(i, x, "e", i) for i, x in enumerate(TEXTS)] + [(3, "again", "e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long").repartition(2)
    got = t.encode_corpus(df).collect()
    assert len(got) == len(rows)
    for r in got:
        source = [x for i, x, *_ in rows if i == r.doc_id]
        assert library.decode(r.ids, skip_special_tokens=False) in [x or "" for x in source]
    assert [r.ids for r in got if r.doc_id in (0, 1)] == [[], []]
    n = {(r.doc_id, r.n_tokens) for r in t.encode_corpus(df, counts_only=True).collect()}
    assert n == {(r.doc_id, len(r.ids)) for r in got}
    assert t.encode_corpus(df.limit(0)).count() == 0
