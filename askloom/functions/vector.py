"""Vector expressions."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.functions import words as W


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty or zero vectors, rounded to 6 places."""
    scale = norm(a) * norm(b)
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0) & (scale > 0), F.round(dot(a, b) / scale, 6)
    ).otherwise(0.0)


def token_codes(text: Column) -> Column:
    """One 32-bit code per token, taken from its md5 (same on every engine)."""
    return F.transform(
        X.tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")
    )


@functools.lru_cache(maxsize=500_000)
def _word_code(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Stand-in for a hosted embedding model: signed feature hashing of tokens.

    Bit 0 of the code is the sign, the remaining bits pick the slot.
    """

    @F.arrow_udf("array<float>")
    def count_slots(texts: pa.Array, spared: pa.Array) -> pa.Array:
        sums = []
        for rows, row, code, words in W.coded(texts, spared):
            codes = np.array([_word_code(w) for w in words.to_pylist()], dtype=np.int64)[code]
            sums.append(np.bincount(row * dim + (codes >> 1) % dim, weights=np.where(codes % 2 == 0, 1.0, -1.0), minlength=(rows.stop - rows.start) * dim))
        ends = pa.array(np.arange(len(texts) + 1) * dim, pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sums).astype(np.float32) if sums else [], pa.float32()))

    return count_slots(text, W.spare(text))
