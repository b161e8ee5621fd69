"""The tokens of ``text.tokens`` for whole Arrow batches, as numbers: words are found by looks at all characters at once.

Texts of Latin letters, CJK characters and their common marks are cut here; where a text holds any other
character, its tokens come with it from the JVM (``spare``).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X

OTHER = r"[^\x00-įı-ɏ‐-‧‰-‾€　-〄〈-〠一-鿿！-／：-？]"
BYTES = 1_000_000  # of text looked at together


def spare(text: Column) -> Column:
    """The tokens of a text that is not cut here, else null."""
    # the long pattern is slow, so Latin texts are told by one range
    return F.when((text.rlike(r"[^\x00-ɏ]") | text.contains("İ")) & text.rlike(OTHER), X.tokens(text))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point below 0x10000: its kind (1 in words, 2 CJK) and its lower case."""
    kind, low = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for c in range(0x250):
        kind[c] = chr(c).isalpha() or chr(c).isdecimal() or chr(c) == "_"
        if len(chr(c).lower()) == 1:
            low[c] = ord(chr(c).lower())
    kind[0x4E00:0xA000] = 2
    return kind, low


def _strings(points: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of code points as strings; each ends at its place in ``ends``."""
    at = np.concatenate(([0], ends))
    at = at + sum(np.searchsorted(np.flatnonzero(points > most), at) for most in (0x7F, 0x7FF))  # bytes beyond the first
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))


def _cut(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of all words and pairs of CJK characters; row i ends at byte ends[i]."""
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    if len(points) != len(data):
        ends = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[np.maximum(ends - 1, 0)] * (ends > 0)
    kind, low = _tables()
    k = kind[np.minimum(points, 0xFFFF)]
    first = np.zeros(len(points) + 1, bool)  # of a row
    first[ends] = True
    word = k == 1
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    stops[:-1] &= ~word[1:] | first[1:-1]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    word[begin[stop - begin == 1]] = False
    begin, stop = begin[stop - begin > 1], stop[stop - begin > 1]
    row, words = np.searchsorted(ends, begin, side="right"), _strings(low[points[word]], np.cumsum(stop - begin))
    if (k == 2).any():
        pair = np.flatnonzero((k[:-1] == 2) & (k[1:] == 2) & ~first[1:-1])
        both = np.stack([points[pair], points[pair + 1]], axis=1).ravel()
        row = np.concatenate([row, np.searchsorted(ends, pair, side="right")])
        words = pa.concat_arrays([words, _strings(both, np.arange(1, len(pair) + 1) * 2)])
    return row, words


def coded(texts: pa.Array, spared: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, pa.Array]]:
    """(rows, row, code, words) of consecutive slices of a batch: each token's row inside its slice and its place in ``words``.

    Null texts have no tokens. Tokens of a row come in no order, each as often as it occurs.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data, stop_words = texts.buffers()[2] if len(texts) else None, pa.array(sorted({w for w in K.STOP_WORDS if len(w) > 1}))
    start = 0
    while start < len(texts):
        stop = max(int(np.searchsorted(offsets, offsets[start] + BYTES, side="right")) - 1, start + 1)
        row, words = _cut(data[int(offsets[start]) : int(offsets[stop])].to_pybytes() if offsets[stop] > offsets[start] else b"", offsets[start + 1 : stop + 1] - offsets[start])
        told = spared.slice(start, stop - start)
        if told.null_count < len(told):
            mine = np.asarray(told.is_null())[row]
            given = told.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.concatenate([row[mine], np.repeat(np.arange(len(told)), given)])
            words = pa.concat_arrays([words.filter(pa.array(mine)), told.flatten().cast(pa.string())])
        held = words.dictionary_encode()
        code = np.asarray(held.indices)
        dropped = np.asarray(pc.is_in(held.dictionary, value_set=stop_words))
        if dropped.any():
            kept = ~dropped[code]
            row, code = row[kept], code[kept]
        yield slice(start, stop), row, code, held.dictionary
        start = stop
