"""Near-duplicate documents: SuperMinHash signatures, banding, exact confirmation, components.

Every shingle of a document draws one random permutation of the signature's positions; the rank at
which it meets a position orders the bids for it, so a position is taken by the earliest bidder
and a document stops as soon as every position is taken. Signatures are cut into bands, documents
that share a band are candidates, and a candidate pair becomes a link only when the full shingle
sets say so.

Results for special input: a null or blank text has no shingles and no links; fewer words than the
shingle's width make one shingle of the whole sequence; equal texts are one class and are linked
through it, not pair by pair; rows that repeat an id are copies of one document and all carry its
flag; a row without id takes its class's component (null if no row of the class has an id), is never
the representative and is kept only if its component is null. An empty table gives no rows. Columns
besides id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import textbytes as B
from askloom.llm.byte_bpe import ranges
from askloom.llm.components import components, stored
from askloom.operators.sizes import broadcast_if

WIDTH = 5
SLOTS = 128
BANDS = 32  # of four slots: a pair at 0.75 shares none with probability 5e-6
ALL_PAIRS = 24  # larger buckets are linked through two members first
BLOCK = 2048  # members of a large bucket compared at once
BLOCK_SHINGLES = 1 << 21  # and their shingles, 8 bytes each
LEAST = 0.5  # estimated likeness under which a pair at 0.75 is out of reach (over 6 sigma)
IDS_BROADCAST = 1_000_000  # 8 bytes each
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted inside it, and the documents' offsets."""
    n = len(first) - 1
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    rolled = B.mix(rolled, 3)
    found = []
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            found.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = B.mix(np.array([whole]) * np.uint64(31) + w, 4)[0]
            found.append(np.array([whole], np.uint64))
        else:
            found.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in found], np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def _draw(e: np.ndarray, step: int, below: int) -> np.ndarray:
    return ((B.mix(e, 100 + step) >> np.uint64(32)) * np.uint64(below) >> np.uint64(32)).astype(np.int64)


def super_min_hash(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents x slots). All documents go through the steps together.

    A bid of step j is above every bid of an earlier step, so a document whose positions are all
    taken is finished; the few that are not go on with their elements' permutations.
    """
    n = len(offsets) - 1
    sig = np.full(n * slots, _EMPTY, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    chosen: list[np.ndarray] = []  # Fisher-Yates draws so far, for the elements still at work
    order = None
    for j in range(slots):
        if not len(doc):
            break
        k = j + _draw(elements, j, slots - j)
        if j == 0:
            place = k
        elif j == 1:
            place = np.where(k == chosen[0], 0, k)
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.int16), (len(doc), 1))
                rows = np.arange(len(doc))
                for i, c in enumerate(chosen):
                    held = order[rows, i].copy()
                    order[rows, i] = order[rows, c]
                    order[rows, c] = held
            rows = np.arange(len(doc))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[rows, j]
            order[rows, j] = place
        bid = (np.uint64(j) << np.uint64(48)) | (B.mix(elements, 500 + j) >> np.uint64(16))
        np.minimum.at(sig, doc * slots + place, bid)
        open_ = (sig.reshape(n, slots) == _EMPTY).any(axis=1)[doc]
        if j < 2:
            chosen = [c[open_] for c in [*chosen, k]]
        if order is not None:
            order = order[open_]
        doc, elements = doc[open_], elements[open_]
    return sig.reshape(n, slots)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key per document and band; keys of different bands differ."""
    n, slots = sig.shape
    parts = B.mix(sig, 5).reshape(n, bands, slots // bands)
    key = np.zeros((n, bands), np.uint64)
    for j in range(slots // bands):
        key = B.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j], 6)
    return B.mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 7)


def _sets(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    data, off = B.utf8(batch.column(column))
    starts, ends, first = B.words(data, off)
    return shingle_hashes(B.span_hashes(data, starts, ends, fold=True), first)


def _binaries(rows: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())]
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, set_a, set_b, bands, likeness bytes) of every document, in one narrow pass."""

    def run(batches):
        for whole in batches:
            for batch in B.slices(whole, "text"):
                elements, off = _sets(batch, "text")
                sig = super_min_hash(elements, off)
                n = len(off) - 1
                totals = []
                for salt in (8, 9):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(B.mix(elements, salt))))
                    totals.append(pa.array((sums[off[1:]] - sums[off[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), pa.array(np.diff(off)), *totals,
                        B.lists(band_keys(sig).ravel().view(np.int64), np.arange(n + 1) * BANDS, pa.int64()),
                        _binaries((B.mix(sig, 10) & np.uint64(255)).astype(np.uint8), np.arange(n + 1) * SLOTS),
                    ],
                    names=["id", "n_shingles", "set_a", "set_b", "bands", "marks"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n_shingles long, set_a long, set_b long, bands array<long>, marks binary"
    )


def shingle_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, shingles): the sorted full set of each document as 8-byte hashes."""

    def run(batches):
        for whole in batches:
            for batch in B.slices(whole, "text"):
                elements, off = _sets(batch, "text")
                yield pa.RecordBatch.from_arrays([batch.column("id"), _binaries(elements, off * 8)], names=["id", "shingles"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, shingles binary")


def _marks(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _likely(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (a, b, ma, mb) whose signatures agree in at least ``LEAST`` of their positions."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array((_marks(b.column("ma")) == _marks(b.column("mb"))).mean(axis=1) >= LEAST)).select(["a", "b"])

    return pairs.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 75 * union of their full sets."""

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                u = np.frombuffer(x.as_buffer(), np.uint64)
                v = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(100 * both >= 75 * (len(u) + len(v) - both))
            yield b.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _small_pairs(members: DataFrame) -> DataFrame:
    """Likely pairs of the buckets of at most ``ALL_PAIRS`` members; their lists are bounded."""

    def run(batches):
        for batch in batches:
            found = []
            for m in batch.column("m").to_pylist():
                ids = np.array([x["id"] for x in m])
                marks = np.frombuffer(b"".join(x["marks"] for x in m), np.uint8).reshape(-1, SLOTS)
                i, j = np.triu_indices(len(ids), 1)
                near = (marks[i] == marks[j]).mean(axis=1) >= LEAST
                found.append(np.column_stack((ids[i[near]], ids[j[near]])))
            pairs = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    listed = members.where(F.col("n") <= ALL_PAIRS).groupBy("key").agg(F.collect_list(F.struct("id", "marks")).alias("m"))
    return listed.select("m").mapInArrow(run, "a long, b long")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Likely pairs of each member of a large bucket with the bucket's smallest id and one other."""
    hot = members.where(F.col("n") > ALL_PAIRS)
    pivots = hot.groupBy("key").agg(
        F.min(F.struct("id", "marks")).alias("p"),
        F.min(F.struct(F.xxhash64("id", "key").alias("rank"), "id", "marks")).alias("q"),
    )
    met = hot.join(stored(pivots, "pivots"), "key")
    return _likely(
        met.select("id", "marks", F.explode(F.array(F.struct("p.id", "p.marks"), F.struct("q.id", "q.marks"))).alias("o"))
        .where(F.col("id") != F.col("o.id"))
        .select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b"), F.col("marks").alias("ma"), F.col("o.marks").alias("mb"))
    )


def _stray_links(members: DataFrame, groups: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links (a, b) between a large bucket's components, where it still holds several.

    Members outside the bucket's largest component are its strays. Each block of members meets the
    strays with their full sets: every pair whose signatures agree in at least ``LEAST`` is checked in
    full unless the block's own links already join its components. A pair that shares several bands
    is checked in the first one's bucket. Both sides are salted into blocks of bounded rows and
    bytes, so no group grows with the bucket, and a block gives fewer links than it has components.
    """
    told = stored(
        members.where(F.col("n") > ALL_PAIRS).join(groups.withColumnRenamed("node", "id"), "id", "left")
        .join(classes.select("id", "n_shingles"), "id")
        .select("key", "id", "n_shingles", "marks", F.coalesce("component", "id").alias("component")),
        "told",
    )
    parts = told.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    whole = parts.groupBy("key").agg(F.max(F.struct("m", "component", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s / BLOCK_SHINGLES))
    mixed = stored(
        whole.where("top.m < m").select(
            "key", F.col("top.component").alias("main"), blocks(F.col("m"), F.col("s")).alias("across"),
            blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("down"),
        ),
        "mixed",
    )
    if mixed.isEmpty():
        return None
    held = stored(told.join(mixed, "key").withColumn("stray", F.col("component") != F.col("main")), "held")
    full = held.join(classes.select("id", "bands"), "id").join(sets, "id")
    read = ["id", "n_shingles", "marks", "component", "stray", "bands", "shingles"]
    left = full.select(
        "key", F.pmod(F.xxhash64("id"), "across").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("y"), *read
    )
    again = [F.col(c).alias(c) for c in ["key", *read]]  # columns of their own, as both sides read the same tables
    right = full.where("stray").select(
        *again, F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("x"), F.pmod(F.xxhash64("id"), "down").alias("y")
    )

    def columns(table):
        ids, sizes, of, stray = (table.column(c).to_numpy() for c in ("id", "n_shingles", "component", "stray"))
        bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
        flat = np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint64)
        return ids, sizes, of.copy(), stray, _marks(table.column("marks")), bands, flat, np.concatenate(([0], np.cumsum(sizes)))

    def run(group, strays):
        links = []
        if len(group) and len(strays):
            key = group.column("key")[0].as_py()
            ids, sizes, of, stray, marks, bands, flat, first = columns(group)
            those, lengths, theirs, _, signs, keys, other, start = columns(strays)
            known, codes = np.unique(flat, return_inverse=True)
            own = np.zeros(len(known), bool)
            for i, x in enumerate(those):
                c, n = theirs[i], lengths[i]
                # two strays meet twice; sets of too different sizes cannot reach 0.75
                at = np.flatnonzero((of != c) & (100 * np.minimum(sizes, n) >= 75 * np.maximum(sizes, n)) & ~(stray & (ids >= x)))
                at = at[bands[at, (bands[at] == keys[i]).argmax(axis=1)] == key]
                near = (marks[at] == signs[i]).mean(axis=1)
                at, near = at[near >= LEAST], near[near >= LEAST]
                at = at[np.argsort(-near, kind="stable")]
                own[:] = False
                mine = other[start[i] : start[i + 1]]
                place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                own[place[known[place] == mine]] = True
                take = 8  # the likeliest first: a link often spares the rest
                while len(at):
                    now, at = at[:take], at[take:]
                    both = np.add.reduceat(own[codes[ranges(first[now], sizes[now])]], np.cumsum(sizes[now]) - sizes[now], dtype=np.int64)
                    for j in now[100 * both >= 75 * (n + sizes[now] - both)]:
                        if of[j] != c:
                            links.append((min(int(x), int(ids[j])), max(int(x), int(ids[j]))))
                            old = of[j]
                            of[of == old] = c
                            theirs[theirs == old] = c
                    at, take = at[of[at] != c], 512
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    by = ["key", "x", "y"]
    return stored(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "a long, b long"), "strays")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Copies are grouped by their sets' 128-bit sums before any comparison. Buckets of up to
    ``ALL_PAIRS`` classes are compared in full. A larger bucket, nearly always one group of near
    copies, is first linked through two of its members; what that leaves in other components is
    then compared with the whole bucket, block by block, every likely pair in full.
    """
    prints = stored(fingerprints(docs, key, text), "prints")
    same = ["set_a", "set_b", "n_shingles"]
    classes = stored(
        prints.where("n_shingles > 0 and id is not null").groupBy(*same)
        .agg(F.min(F.struct("id", "bands", "marks")).alias("f")).select(*same, "f.id", "f.bands", "f.marks"),
        "classes",
    )
    keys = classes.select("id", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keys.join(sizes, "key").join(classes.select("id", "marks"), "id"), "members")
    ids = stored(members.select("id").distinct(), "ids")
    wanted = broadcast_if(ids.withColumnRenamed("id", key), ids.count(), IDS_BROADCAST)
    sets = stored(shingle_sets(docs.join(wanted, key, "left_semi"), key, text).dropDuplicates(["id"]), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        return stored(_confirmed(pairs.distinct(), sets), "confirmed")

    links = linked(_small_pairs(members).unionByName(_pivot_pairs(members)))
    groups = components(links)
    more = _stray_links(members, groups, classes, sets)
    if more is not None and not more.isEmpty():
        groups = components(links.unionByName(more))
    named = stored(
        classes.select(*same, "id").join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select(*same, F.coalesce("component", "id").alias("component_id")),
        "named",
    )
    return prints.select("id", *same).join(named, same, "left").select(
        F.col("id").alias(key), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))
