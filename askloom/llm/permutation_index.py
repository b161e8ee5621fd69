"""Nearest neighbours by cosine through a permutation index.

A bounded sample of vectors serves as pivots. Every vector is represented by the order of its pivots
from near to far; a block of vectors keeps, for each pivot, an inverted file of the places at which
the block's vectors hold that pivot. A query opens the files of its own nearest pivots, adds up the
differences of place (Spearman's footrule, places capped at the opened depth), and the best share of
each block is ranked again by exact cosine.

Results for special input: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, as query or as candidate; equal vectors are searched once and
come back by id, smallest first, and so do scaled copies, whose cosines agree to 13 digits; rows that repeat an id and vector count once; an id with several
vectors is a candidate with each and asks with the smallest; with fewer candidates than asked for all
are returned; an empty table gives no rows. Columns besides id and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm.components import stored

PIVOTS = 256  # sampled vectors, the smallest by hash
OPENED = 255  # nearest pivots whose files a query opens
BLOCK_ROWS = 1024  # vectors of one block
QUERY_ROWS = 4096  # queries that meet a block at once
SHARE = 0.25  # of a block, best by footrule, is ranked by cosine: measured recall 0.96 to 1.0 (README)
LEAST = 32  # but so many at least
TIE_DIGITS = 13  # cosines alike so far are ties: those of scaled copies differ in the last bits alone


def valid_vectors(table: DataFrame, key: str, vector: str, length: int | None = None) -> DataFrame:
    """(id, v) with finite, non-zero vectors of one length: the given one, or else the most common."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(
        ~odd & ~zero
    )
    if length is not None:
        return rows.where(F.size("v") == length)
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): distinct vectors and their ``keep`` smallest ids; more can never be returned.

    The rank limit is cut inside each task before the shuffle, so a vector shared by a third of all
    rows stays small.
    """
    order = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.array_distinct(F.collect_list("id"))).alias("ids"))


def build(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(ids, v, places): places[p] is the rank of pivot p from the vector, 0 the nearest, one byte each."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def run(batches):
        for b in batches:
            v = _matrix(b.column("v"))
            yield pa.RecordBatch.from_arrays([b.column("ids"), b.column("v"), pa.array([p.tobytes() for p in places(v, held.value)], pa.binary())], names=["ids", "v", "places"])

    return rows.select("ids", "v").mapInArrow(run, "ids array<long>, v array<double>, places binary")


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten()).reshape(n, -1) if n else np.zeros((0, 0))


def places(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    near = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ pivots.T
    order = np.argsort(-near, axis=1, kind="stable")
    out = np.empty(order.shape, np.uint8)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
    return out


def footrules(files: np.ndarray, asked: np.ndarray, opened: int) -> np.ndarray:
    """Footrule of one query to each vector of a block; ``files`` (pivot x vector) are capped places."""
    near = np.flatnonzero(asked < opened)
    own = asked[near][:, None]
    lists = files[near]
    return (np.maximum(lists, own) - np.minimum(lists, own)).sum(axis=0, dtype=np.int32)


def search_block(ids: list[list[int]], v: np.ndarray, ranks: np.ndarray, q_ids, q_v: np.ndarray, q_ranks: np.ndarray, k: int):
    """(query, id, cosine) of each query's ``k`` best of one block."""
    files = np.ascontiguousarray(np.minimum(ranks, OPENED).T)
    norms = np.linalg.norm(v, axis=1)
    count = max(LEAST, int(np.ceil(SHARE * len(v))))
    out = []
    for q, x, asked in zip(q_ids, q_v, q_ranks, strict=True):
        far = footrules(files, asked, OPENED)
        best = np.arange(len(v)) if len(v) <= count else np.argpartition(far, count - 1)[:count]
        cosines = np.clip((v[best] @ x) / (norms[best] * np.linalg.norm(x)), -1, 1)
        near = np.round(cosines, TIE_DIGITS)
        found = []
        for i in np.lexsort(([ids[b][0] for b in best], -near))[: k + 1]:
            found += [(-near[i], id_, float(cosines[i])) for id_ in ids[best[i]] if id_ != q]
        out += [(q, id_, c) for _, id_, c in sorted(found)[:k]]
    return out


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows of ``table`` found for each row of ``queries``.

    Blocks of vectors meet blocks of queries by key, each pair of blocks in one bounded group, and
    leave at most ``k`` rows a query behind.
    """
    classes = stored(_classes(valid_vectors(table, key, vector), k + 1), "classes")
    chosen = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()
    if not chosen:
        return classes.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(key), F.lit(0.0).alias("score")).limit(0)
    pivots = np.array([r["v"] for r in chosen])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    index = stored(build(classes, pivots), "index")
    blocks = max(1, -(-index.count() // BLOCK_ROWS))
    asks = valid_vectors(queries, key, vector, pivots.shape[1]).groupBy("id").agg(F.min("v").alias("v"))
    asks = stored(build(asks.select(F.array("id").alias("ids"), "v"), pivots), "asks")
    sides = max(1, -(-asks.count() // QUERY_ROWS))
    left = index.select(
        F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1)).cast("array<long>")).alias("side"),
        "ids", "v", "places",
    )
    right = asks.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), F.pmod(F.xxhash64("ids"), F.lit(sides)).alias("side"),
        F.col("ids")[0].alias("id"), "v", "places",
    )

    def run(group, asked):
        rows = []
        if len(group) and len(asked):
            ranks = [np.frombuffer(b"".join(t.column("places").to_pylist()), np.uint8).reshape(len(t), -1) for t in (group, asked)]
            rows = search_block(group.column("ids").to_pylist(), _matrix(group.column("v")), ranks[0], asked.column("id").to_pylist(), _matrix(asked.column("v")), ranks[1], k)
        q, i, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    found = left.groupBy("block", "side").cogroup(right.groupBy("block", "side")).applyInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", TIE_DIGITS)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
