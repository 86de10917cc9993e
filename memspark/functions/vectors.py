"""Embeddings and vector arithmetic."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.window import Window

from memspark.functions import text as tx

#: Texts whose words are held at a time.
SLICE = 256
_TOKEN = re.compile(r"\w+")


def _dims_and_signs(tokens: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    digests = [hashlib.sha256(t.encode("utf-8")).digest() for t in tokens]
    dims = np.array([int.from_bytes(d[:2], "big") % dim for d in digests], dtype=np.int64)
    return dims, np.array([1.0 if d[2] & 1 else -1.0 for d in digests])


def hash_embedding(text: Column, dim: int = 1024) -> Column:
    """Dense unit vector of signed token hashes; zero vector for a text without words.

    One Arrow batch in, one out, no shuffle. Words are taken from ``SLICE`` texts at a time, whatever the batch holds;
    the digest of each distinct word is taken once per slice.
    """

    def some(batch: pa.Array) -> np.ndarray:
        found = [_TOKEN.findall((s or "").lower()) for s in batch.to_pylist()]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        words = pa.array([t for f in found for t in f], pa.string()).dictionary_encode()
        dims, signs = _dims_and_signs(words.dictionary.to_pylist(), dim)
        codes = words.indices.to_numpy(zero_copy_only=False)
        sums = np.bincount(rows * dim + dims[codes], weights=signs[codes], minlength=len(found) * dim).astype(np.float64)
        out = sums.reshape(len(found), dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0)

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(batch: pa.Array) -> pa.Array:
        out = np.empty((len(batch), dim))
        for start in range(0, len(batch), SLICE):
            out[start : start + SLICE] = some(batch.slice(start, SLICE))
        offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return embed(text)


def hash_embedding_sparse(df: DataFrame, id_col: str, text_col: str, dim: int = 1024) -> DataFrame:
    """The same embedding as (id, dim, weight) rows with built-in functions only; zero weights are left out."""
    tokens = df.select(F.col(id_col), F.explode(tx.words(F.col(text_col))).alias("token"))
    # Four hexadecimal digits are the slot, the last bit of the next two the sign.
    digits = tokens.select(id_col, F.conv(F.substring(F.sha2("token", 256), 1, 6), 16, 10).cast("int").alias("digits"))
    sign = F.when(F.col("digits") % 2 == 1, 1).otherwise(-1)
    slots = digits.select(id_col, F.pmod(F.shiftright("digits", 8), F.lit(dim)).alias("dim"), sign.alias("signed"))
    # Words are summed by slot where they are, so that no word is shuffled.
    sums = slots.groupBy(id_col, "dim").agg(F.sum("signed").cast("double").alias("raw")).filter("raw <> 0")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return sums.select(id_col, "dim", (F.col("raw") / norm).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector is null or has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


# Embedders by name: text column -> vector column. A vector that cannot be made must come back null.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hash": hash_embedding}


def register_embedder(name: str, embed: Callable[[Column], Column]) -> None:
    EMBEDDERS[name] = embed


def embed_text(c: Column, embedder: str = "hash") -> Column:
    """Vector of a text by a registered embedder; null for blank text."""
    stripped = tx.strip(tx.text_or_empty(c))
    return F.when(stripped != "", EMBEDDERS[embedder](stripped))
