"""Best-fit packing of token lists into sequences of one length, with a fixed number of open bins.

A packer keeps at most ``open_bins`` unfinished sequences, indexed by a bitset with one bit per free
space. A piece goes to the open bin with the least space that still holds it; where none does, a new
bin opens, and when there are too many the fullest closes. Each task packs what it reads, so nothing
is shuffled and memory is one batch plus the open bins.

Results for special input: a row whose list is null or empty gives one piece of length 0, placed
at the end of what the fullest open bin holds (in a new one if none is open); only lists longer than a sequence are cut, and then the
first piece takes the remainder; rows that repeat are each packed; an empty table gives no rows;
columns besides key and ids are not returned.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import byte_bpe

SIZE = 2048
OPEN_BINS = 64


class Packer:
    """Bounded-space online best fit."""

    def __init__(self, size: int = SIZE, open_bins: int = OPEN_BINS, first: int = 0):
        self.size, self.open_bins, self.next = size, open_bins, first
        self.free = [deque() for _ in range(size + 1)]
        self.bits = 0  # bit f is set while a bin with f free places is open
        self.count = 0

    def _take(self, space: int) -> int:
        held = self.free[space]
        found = held.popleft()
        if not held:
            self.bits &= ~(1 << space)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of ``length`` tokens."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(space)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            space, sequence = self.size, self.next
            self.next += 1
        left = space - length
        if left:
            self.free[left].append(sequence)
            self.bits |= 1 << left
            self.count += 1
        return sequence, self.size - space


def cut(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a list's pieces: the remainder first, then full ones."""
    if length <= size:
        return [(0, length)]
    head = length % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, length, size)]


PLACES = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def packer(size: int = SIZE, open_bins: int = OPEN_BINS):
    """Function of Arrow batches (key, ids) that yields the pieces' places, batch by batch.

    Sequences are numbered by task, so a task that runs again gives the same numbers.
    """

    def run(batches):
        context = TaskContext.get()
        bins = Packer(size, open_bins, (context.partitionId() if context else 0) << 40)
        for b in batches:
            lists = b.column("ids")
            off = np.asarray(lists.offsets).astype(np.int64)
            flat = np.ascontiguousarray(np.asarray(lists.values).astype("<u4", copy=False))
            owners, rows = [], []
            for i in range(len(lists)):
                for piece, (start, length) in enumerate(cut(int(off[i + 1] - off[i]), size)):
                    sequence, offset = bins.place(length)
                    at = off[i] + start
                    rows.append((piece, start, length, zlib.crc32(flat[at : at + length]), sequence, offset))
                    owners.append(i)
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(owners, pa.int64())), pa.array(columns[0].astype(np.int32)), *[pa.array(c) for c in columns[1:]]],
                names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", size: int = SIZE, open_bins: int = OPEN_BINS) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``encoded``."""
    kind = encoded.schema[key].dataType.simpleString()
    got = encoded.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids")).mapInArrow(
        packer(size, open_bins), f"key {kind}, {PLACES}"
    )
    return got.withColumnRenamed("key", key)


def pack_texts(docs: DataFrame, tokens: dict[bytes, int], last: int, key: str = "doc_id", text: str = "text", size: int = SIZE, open_bins: int = OPEN_BINS, added: dict[str, int] | None = None) -> DataFrame:
    """``pack`` of the texts' ids, each text followed by the id ``last``; ``added`` tokens in a text are one id each.

    Encoding and packing run in one pass of one worker, slice by slice, so no list of ids leaves it.
    """
    encoded, places = byte_bpe.encoder(byte_bpe.shared(docs, tokens), False, last, added), packer(size, open_bins)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda batches: places(encoded(batches)), f"key {kind}, {PLACES}").withColumnRenamed("key", key)
