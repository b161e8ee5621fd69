"""Similar texts across a whole corpus: an exact set-similarity join that moves no set of trigrams.

Every text is its set of character trigrams, made where the text is read. If two sets differ in at most k
elements and the hash space is cut into k + 1 parts, they agree completely in at least one part, so one scan
leaves of each text the hashes of its parts and a sketch of 1 024 parity bits; bits that differ are elements
that differ. Texts that share a part and pass by their sketches are links; links are gathered to components
inside tasks first, and only texts of components of two and more are fetched again and compared on their full
sets. Parts that very many texts share, and large components, are dealt into blocks; pairs of blocks are tasks
of their own, and no table of pairs is written.

``ranked_sets`` and ``candidates`` are the same join by rarest-first prefixes, over sets that are stored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X
from askloom.operators.runs import running
from askloom.operators.sizes import broadcast_if
from askloom.session import settle

BLOCK = 256  # rows of a prefix bucket that meet as one block
GRAMS_BROADCAST = 2_000_000  # counted trigrams, sixteen bytes each, that are broadcast to the texts
IDS_BROADCAST = 1_000_000  # 8 bytes each
NEIGHBOURS = 64  # keys of a block whose texts are compared in order
SORT_ROWS = 512  # texts whose trigrams are sorted at once
SKETCH_BITS = 1024  # parity bits of a text
LINKS_LOCAL = 1_000_000  # links that one task gathers to components
VOCABULARY = 8192  # trigrams of a group that are multiplied at once


def ranked_sets(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, s): distinct texts' trigram sets as hashes, rarest of the corpus first; ids are the smallest of equal sets.

    Counts are taken over distinct sets. Columns ``copies`` says how many rows of the table share a set.
    """
    grams = texts.select(F.col(key).alias("id"), F.transform(X.shingles(F.coalesce(F.col(text), F.lit(""))), lambda g: F.xxhash64(g)).alias("g")).where(F.size("g") > 0)
    same = grams.select("id", F.array_sort("g").alias("g")).groupBy(F.md5(F.array_join(F.col("g").cast("array<string>"), ",")).alias("digest")).agg(
        F.min(F.struct("id", "g")).alias("f"), F.count(F.lit(1)).alias("copies")
    )
    sets = settle(same.select("f.id", "f.g", "copies"))
    parts = sets.select("id", F.explode("g").alias("t"))
    often = settle(parts.groupBy("t").agg(F.count(F.lit(1)).alias("c")))
    if often.count() <= GRAMS_BROADCAST:
        return _ordered(sets, often)
    # the trigrams of a text meet again in its own row, so only a corpus of very many trigrams moves them
    counted = parts.join(often, "t")
    order = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("s"))
    return sets.select("id", "copies").join(order, "id").select("id", "copies", F.size("s").alias("n"), F.transform("s", lambda x: x["t"]).alias("s"))


def _ordered(sets: DataFrame, often: DataFrame) -> DataFrame:
    """(id, copies, n, s): each row's trigrams put in order of their broadcast counts; nothing is shuffled."""
    table = often.orderBy("t").toArrow()
    told = sets.sparkSession.sparkContext.broadcast((table.column("t").to_numpy(), table.column("c").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = told.value
        for whole in batches:
            for start in range(0, whole.num_rows, SORT_ROWS):
                b = whole.slice(start, SORT_ROWS)
                n = b.column("g").value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
                grams = b.column("g").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort([grams, counts[np.searchsorted(known, grams)], row])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(grams[order]))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("copies"), pa.array(n), lists], names=["id", "copies", "n", "s"])

    return sets.select("id", "copies", "g").mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, copies bigint, n int, s array<bigint>")


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b that share a prefix element and pass the length and position filters.

    Two sets of sizes m <= n can reach the threshold only if m >= threshold * n; of a first common
    element at places i and j at most 1 + min(m - i, n - j) elements can be shared.
    """
    prefix = sets.select(
        "id", "n", F.posexplode(F.slice("s", 1, F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)).alias("i", "t")
    )
    sizes = prefix.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    parts = settle(prefix.join(sizes, "t").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    # block x meets block y >= x: a row goes out as left with its own block first, as right with every block up to its own
    left = parts.select("t", F.col("id").alias("a"), F.col("n").alias("m"), F.col("i").alias("p"), F.col("at").alias("x"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("y"))
    right = parts.select("t", F.col("id").alias("b"), "n", F.col("i").alias("q"), F.col("at").alias("y"), F.explode(F.sequence(F.lit(0), F.col("at"))).alias("x"))
    met = left.join(right, ["t", "x", "y"]).where((F.col("x") < F.col("y")) | (F.col("a") < F.col("b")))
    small, big = F.least("m", "n"), F.greatest("m", "n")
    shared = F.least(F.col("m") - F.col("p"), F.col("n") - F.col("q"))
    need = F.ceil((F.col("m") + F.col("n")) * threshold / (1 + threshold) - 1e-9)
    fits = met.where((small >= threshold * big - 1e-9) & (shared >= need))
    return fits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of unsigned numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _parts(h: np.ndarray, threshold: float) -> np.ndarray:
    """Hashes of the parts of a set, given by its elements' hashes: sets that reach the threshold share one.

    Sizes fall into bands as wide as the threshold lets two sizes differ; a set meets those of its own band and of
    the next one on either side.
    """
    if threshold >= 1:  # only equal sets, and those are one class
        return np.empty(0, np.uint64)
    step, ratio = math.log(1 / threshold), (1 - threshold) / (1 + threshold)
    band = math.floor(math.log(len(h)) / step + 1e-9)
    out, halves = [], ((h & np.uint64(0xFFFFFFFF)).astype(np.float64), (h >> np.uint64(32)).astype(np.float64))
    for b in range(max(band - 1, 0), band + 1):
        parts = int(ratio * 2 * (math.exp(step * (b + 2)) + 1) + 1e-9) + 1
        if parts > 1:  # else only equal sets reach the threshold
            part = (h % np.uint64(parts)).astype(np.int64)
            low, high = (np.bincount(part, weights=x, minlength=parts).astype(np.uint64) for x in halves)  # exact below 2 ** 21 elements
            at = np.arange(parts, dtype=np.uint64) + (np.uint64(b) << np.uint64(32))
            out.append(_mixed(_mixed(low + (high << np.uint64(32))) + _mixed(at + np.uint64(1))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketches(texts: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(id, copies, n, bits, parts): of each distinct set its smallest id, size, parity bits and hashed parts, by one scan."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SORT_ROWS):
                b = whole.slice(start, SORT_ROWS)
                at, digests, sizes, bits, parts = [], [], [], [], []
                for i, t in enumerate(b.column("text").to_pylist()):
                    grams = _trigrams(t or "")
                    if not len(grams):
                        continue
                    h = _mixed(grams.astype(np.uint64))
                    odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
                    at.append(i)
                    digests.append(hashlib.md5(grams.tobytes()).digest())
                    sizes.append(len(grams))
                    bits.append(np.packbits(odd.astype(bool)).tobytes())
                    parts.append(_parts(h, threshold).view(np.int64))
                ends = np.cumsum([0, *map(len, parts)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at, pa.int64())), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), lists],
                    names=["id", "digest", "n", "bits", "parts"],
                )

    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, digest binary, n int, bits binary, parts array<bigint>")
    same = rows.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "bits", "parts")])
    return same.drop("digest")


def _rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a - b that are not the smallest of their component, and that smallest one."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    low = np.arange(len(nodes))
    while len(x):
        least = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], least)
        np.minimum.at(low, low[y], least)
        while (low != low[low]).any():
            low = low[low]
        open_ = low[x] != low[y]
        x, y = x[open_], y[open_]
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved], nodes[low[moved]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links (a, b) as each node with the smallest node it reaches there."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a, b = _rooted(np.concatenate([a, batch.column("a").to_numpy()]), np.concatenate([b, batch.column("b").to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _components(links: DataFrame) -> DataFrame:
    """(id, root) of every node of the links (a, b) with b < a; few links go to one task, more to alternating stars."""
    now = settle(links)
    n = now.count()
    if n <= LINKS_LOCAL:
        now = settle(now.repartition(1).mapInArrow(_forest, "a bigint, b bigint"))
    else:
        seen = None
        while True:
            told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if told == seen:
                break
            seen = told
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).where("m < a").select(F.col("a").alias("b"), "m")
            large = settle(now.join(settle(low), "b", "left").select("a", F.coalesce("m", "b").alias("b")).where("a <> b").distinct())
            low = settle(large.groupBy("a").agg(F.min("b").alias("m")))
            moved = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = settle(low.select("a", F.col("m").alias("b")).unionByName(moved).distinct())
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _dealt(rows: DataFrame, count: str) -> DataFrame:
    """Rows of groups of ``count`` rows in blocks: each goes to every pair of blocks x <= y that its own block ``at`` is one of."""
    blocks = F.ceil(F.col(count) / BLOCK).cast("int")
    told = rows.withColumn("at", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return told.withColumns({"x": F.least("at", "o"), "y": F.greatest("at", "o")}).drop("o", count)


def links_of(sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b), b < a, that join every two sets that share a part and whose sizes and sketches let them reach the threshold."""
    rows = sets.where("id IS NOT NULL").select("id", F.explode("parts").alias("part"))
    shared = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("part"))).where("c > 1")
    met = _dealt(shared.join(sets.select("id", "n", "bits"), "id"), "c")
    ratio, words = (1 - threshold) / (1 + threshold), SKETCH_BITS // 64

    def paired(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Links of whole groups, which stand together."""
        id_, n, at, x, y, part = (t.column(c).to_numpy() for c in ("id", "n", "at", "x", "y", "part"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, words)
        group = np.cumsum(np.concatenate(([0], (part[1:] != part[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in range(1, t.num_rows):
            i = np.flatnonzero(group[d:] == group[:-d])
            if not len(i):
                break
            j = i + d
            fit = ((x[i] == y[i]) | (at[i] != at[j])) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[fit], j[fit]
            near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= ratio * (n[i].astype(np.int64) + n[j]) + 1e-9
            left.append(id_[i[near]])
            right.append(id_[j[near]])
        return _rooted(np.concatenate(left), np.concatenate(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)
        held = None
        for batch in _and_end(batches):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None:
                whole, held = held, None
            else:
                both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                last = [both.column(c)[-1].as_py() for c in ("part", "x", "y")]
                same = np.logical_and.reduce([both.column(c).to_numpy() == v for c, v in zip(("part", "x", "y"), last, strict=True)])
                cut = both.num_rows - int(same.sum())
                whole, held = both.slice(0, cut), both.slice(cut)
            if whole is not None and whole.num_rows:
                more = paired(whole)
                a, b = _rooted(np.concatenate([a, more[0]]), np.concatenate([b, more[1]]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = met.select(F.col("id").cast("bigint").alias("id"), "n", "bits", "part", "at", "x", "y")
    return rows.repartition("part", "x", "y").sortWithinPartitions("part", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _likeness(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarities of some sets to others, by products of bounded size."""
    n = np.array([len(s) for s in sets])
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, everywhere = np.repeat(np.arange(len(sets)), n), held == len(sets)
    # elements of one set alone are shared by no two, those of all sets by every two
    kept = (held > 1) & ~everywhere
    number, mine = np.cumsum(kept) - 1, kept[code]
    code, row = number[code[mine]], row[mine]
    shared = np.full((len(left), len(right)), float(everywhere.sum()) if len(sets) > 1 else 0.0)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for lo in range(0, int(kept.sum()), VOCABULARY):
        here = slice(*np.searchsorted(code, [lo, lo + VOCABULARY]))
        m = np.zeros((len(sets), VOCABULARY), np.float32)
        m[row[here], code[here] - lo] = 1
        shared += m[left] @ m[right].T
    return shared / (n[left][:, None] + n[right][None, :] - shared)


def similar_texts(texts: DataFrame, key: str, text: str, threshold: float = K.DUPLICATE_THRESHOLD) -> DataFrame:
    """(id, copies, links, nearest, similarity): each distinct set with the number of others like it, and the likest.

    Texts without a trigram are like nothing. Equal sets are one class, under their smallest id, and not like each
    other. Ties for the likest go to the smaller id. Keys are whole numbers.
    """
    sets = settle(sketches(texts, key, text, threshold))
    roots = _components(links_of(sets, threshold))
    sizes = settle(roots.groupBy("root").agg(F.count(F.lit(1)).alias("c")))
    named = settle(roots.join(broadcast_if(sizes, sizes.count(), IDS_BROADCAST), "root"))
    held = texts.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).join(broadcast_if(named, named.count(), IDS_BROADCAST), "id")

    def compare(group: pa.Table) -> pa.Table:
        ids, at = group.column("id").to_numpy(), group.column("at").to_numpy()
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        left, right = np.flatnonzero(at == x), np.flatnonzero(at == y)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        if len(left) and len(right):
            like = _likeness([_trigrams(t) for t in group.column("text").to_pylist()], left, right)
            if x == y:
                np.fill_diagonal(like, -1)
            for rows, others, s in [(left, right, like)] if x == y else [(left, right, like), (right, left, like.T)]:
                links = (s >= threshold - 1e-12).sum(axis=1)
                most = s.max(axis=1)
                nearest = np.where(s == most[:, None], ids[others][None, :], np.iinfo(np.int64).max).min(axis=1)
                out.append(tuple(v[links > 0] for v in (ids[rows], links, most, nearest)))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["id", "links", "similarity", "nearest"])

    met = _dealt(held, "c").groupBy("root", "x", "y").applyInArrow(compare, "id bigint, links bigint, similarity double, nearest bigint")
    told = met.groupBy("id").agg(F.sum("links").alias("links"), F.max(F.struct("similarity", (-F.col("nearest")).alias("o"))).alias("m"))
    return sets.select("id", "copies").join(told, "id", "left").select(
        F.col("id").alias(key), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        (-F.col("m.o")).alias("nearest"), F.col("m.similarity").alias("similarity"),
    )


def _trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text in ascending order, three code points of 21 bits in a number."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(c) and c.max() < 1024:  # half as wide numbers are sorted faster
        g = np.unique(c[:-2] << 20 | c[1:-1] << 10 | c[2:]).astype(np.int64)
        return (g >> 20) << 42 | (g >> 10 & 1023) << 21 | g & 1023
    c = c.astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


hashed_parts, trigram_codes = _parts, _trigrams  # for parents of one document


def hashed(codes: np.ndarray) -> np.ndarray:
    return _mixed(codes.astype(np.uint64))


def similarity_to_previous(texts: DataFrame, key: str, text: str, block: int = NEIGHBOURS) -> DataFrame:
    """(key, similarity): Jaccard similarity of each text's trigrams to those of the text before it in key order.

    Texts meet in blocks of keys, each with the last text before the block, so a text is moved once or twice and
    its trigrams are made as often. Keys may have gaps. The first text, and those after a null text, have no
    row; a null text's similarity is null.
    """
    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    at = F.floor(F.col("id") / block).alias("block")
    last = rows.select("id", at).groupBy("block").agg(F.max("id").alias("last"))
    # ids alone: the last one before each block
    before = settle(running(last, [], "block", {"id": ("max", F.col("last"))}, include_current=False).where("id is not null").select("id", "block"))
    lent = rows.join(broadcast_if(before, before.count(), IDS_BROADCAST), "id").select("id", "text", "block")
    dealt = rows.select("id", "text", at).unionByName(lent)

    def compare(group: pa.Table) -> pa.Table:
        ids, held = group.column("id").to_numpy(), group.column("text").to_pylist()
        first = group.column("block")[0].as_py() * block
        out, previous = [], None
        for i in np.argsort(ids):
            grams = None if held[i] is None else _trigrams(held[i])
            if previous is not None and ids[i] >= first:
                both = None
                if grams is not None:
                    # two ascending runs: a stable sort merges them, and what they share stands twice
                    merged = np.sort(np.concatenate([previous, grams]), kind="stable")
                    shared = int((merged[1:] == merged[:-1]).sum())
                    both = shared / (len(merged) - shared) if len(previous) and len(grams) else 0.0
                out.append((ids[i], both))
            previous = grams
        return pa.table({"id": pa.array([x for x, _ in out], pa.int64()), "similarity": pa.array([s for _, s in out], pa.float64())})

    found = dealt.groupBy("block").applyInArrow(compare, "id bigint, similarity double")
    return found.select(F.col("id").alias(key), "similarity")
