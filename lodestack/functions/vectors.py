"""Embeddings and vector arithmetic."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.settings import DEFAULTS

TOKEN = r"[a-z0-9]+"


class Embedder(Protocol):
    """Turns texts into unit vectors; loaded once in each worker."""

    dim: int
    name: str

    def __call__(self, texts: Iterable[str]) -> np.ndarray: ...


class HashedBow:
    """The offline default: counts of hashed tokens, scaled to unit length; a text without tokens is a zero vector."""

    name = "hashed-bow"

    def __init__(self, dim: int = DEFAULTS.embedding_dim):
        self.dim = dim

    def __call__(self, texts: Iterable[str]) -> np.ndarray:
        rows = [[zlib.crc32(t.encode()) % self.dim for t in re.findall(TOKEN, (x or "").lower())] for x in texts]
        out = np.zeros((len(rows), self.dim))
        for i, r in enumerate(rows):
            if r:
                out[i] = np.bincount(r, minlength=self.dim)
                out[i] /= np.linalg.norm(out[i])
        return out


def embed(text: Column, embedder: Embedder | None = None, batch: int = 256) -> Column:
    """array<double> of each text by an Arrow UDF over the embedder."""
    e = embedder or HashedBow()

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        m = np.zeros((len(texts), e.dim))
        for i in range(0, len(texts), batch):
            m[i : i + batch] = e(texts.slice(i, batch).to_pylist())
        offsets = np.arange(0, m.size + 1, e.dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))

    return run(text)


def token_weights(text: Column) -> Column:
    """Native sparse form of the default embedding before scaling: the hashed buckets of the tokens."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(DEFAULTS.embedding_dim)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector scaled to length 1; a zero vector is left as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
