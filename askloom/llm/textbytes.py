"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

Batches are cut into slices of bounded bytes before any per-byte array is made, so memory does not
follow the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = U64(0x9E3779B97F4A7C15)
_UNSTEP = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser (splitmix64) of ``x`` under a salt."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64), 1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, kept up to one slice's length."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_STEP, _UNSTEP):
        p = np.full(n, base, U64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=U64))
    if n <= 4 * SLICE_BYTES:
        _POWERS[:] = made
    return made[0], made[1]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Row slices of a batch whose texts hold at most ``limit`` bytes, or one row."""
    yield from _cut(batch, pc.binary_length(batch.column(column)), limit)


def list_slices(batch: pa.RecordBatch, column: str, limit: int):
    """Row slices of a batch whose lists hold at most ``limit`` values, or one row."""
    yield from _cut(batch, pc.list_value_length(batch.column(column)), limit)


def _cut(batch: pa.RecordBatch, lengths: pa.Array, limit: int):
    sizes = np.asarray(pc.fill_null(lengths, 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; nulls are empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[off[0] : off[-1]] if held is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space, and each row's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = ~gap
    start[1:] &= gap[:-1] | edge[1:-1]
    end = ~gap
    end[:-1] &= gap[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a sequence of hashed symbols: a polynomial read off one running sum."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64), 2)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; with ``fold``, A-Z count as a-z."""
    return span_sums((_BYTE_FOLDED if fold else _BYTE)[data], starts, ends)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def with_columns(batch: pa.RecordBatch, keep: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """The named columns of a batch followed by new ones."""
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in keep] + list(columns.values()), names=[*keep, *columns]
    )
