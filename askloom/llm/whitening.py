"""Whitening of an embeddings table by a covariance over its distinct vectors.

Every entry c becomes the whole number x = floor(64 c) + 1000000. Rows with the same x vector are
counted as one class; the fit list takes each class once, or as often as its rows (``weights``). Sums
are exact; the covariance is summed task by task as weighted matrix products of vectors that have had
their mean taken off, and only its dimensions x dimensions entries reach the driver. Each class is
projected and scaled once, and its rows get the result by a join on the class.

A class is written as its offsets from 1000000 in as few bytes as its largest needs, so that the
shuffles carry little more than a byte per dimension. Classes with more than a stated share of all
rows are broadcast, fewer than HEAVY of them; the others are joined by key.

Results for special input: a vector that is null, empty, of another length than most rows have, or
holds a null or non-finite entry or one of 2^50 or more takes no part (of lengths equally common, the
shorter counts); null and repeated ids are rows like others; components whose eigenvalue is zero to
double precision, as when all vectors are equal, do not exist, and there are no rows if none is left
(an empty table, for one); a deviation that does not fit a long is null. Columns besides id and vector
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.components import stored

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
HEAVY = 256
LARGEST = 2.0**50  # entries beyond have no exact whole number in the arithmetic used
_WIDTHS = (1, 2, 4, 8)


def _matrices(column: pa.Array):
    """(rows, matrix) for each length of the vectors in a list column, nulls as NaN."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    for n in np.unique(lengths):
        if n:
            rows = np.flatnonzero(lengths == n)
            flat = column.take(pa.array(rows)).flatten().cast(pa.float64(), safe=False)
            yield rows, flat.to_numpy(zero_copy_only=False).reshape(-1, n)


def pack(y: np.ndarray) -> list[bytes]:
    """Offsets of each vector: their width in bytes, then the offsets in that width."""
    most = np.maximum(y.max(axis=1), -1 - y.min(axis=1))
    out = [b""] * len(y)
    width = np.select([most < 1 << (8 * w - 1) for w in _WIDTHS[:-1]], _WIDTHS[:-1], _WIDTHS[-1])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for i, row in zip(at, y[at].astype(f"<i{w}"), strict=True):
            out[i] = bytes([w]) + row.tobytes()
    return out


def unpack(packed: list[bytes], dims: int) -> np.ndarray:
    y = np.empty((len(packed), dims), np.int64)
    for i, b in enumerate(packed):
        y[i] = np.frombuffer(b, f"<i{b[0]}", offset=1)
    return y


def whole_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dims, packed) of the rows that take part, whatever their length."""

    def run(batches):
        for b in batches:
            ids, dims, packed = [], [], []
            for rows, v in _matrices(b.column("v")):
                v = SCALE * v
                fine = np.all(np.abs(v) < LARGEST, axis=1)  # NaN is not
                ids.append(rows[fine])
                dims.append(np.full(int(fine.sum()), v.shape[1]))
                packed += pack(np.floor(v[fine]).astype(np.int64)) if fine.any() else []
            if ids:
                took = b.column("id").take(pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([took, pa.array(np.concatenate(dims), pa.int32()), pa.array(packed, pa.binary())], names=["id", "dims", "packed"])

    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    return rows.mapInArrow(run, "id long, dims int, packed binary")


def _batches(dims: int, batches, weighted: bool):
    for b in batches:
        y = unpack(b.column("packed").to_pylist(), dims)
        yield b, y, b.column("copies").to_numpy() if weighted else np.ones(len(y), np.int64)


def sums(classes: DataFrame, dims: int, weighted: bool) -> tuple[int, list[int], int]:
    """(n, sum of offsets per dimension, largest offset) over the fit list, exact."""

    def run(batches):
        n, s, most = 0, np.zeros(dims, object), 0
        for _, y, w in _batches(dims, batches, weighted):
            n, most = n + int(w.sum()), max(most, int(np.abs(y).max(initial=0)))
            near = most * max(1, int(w.max(initial=1))) * len(y) < 2**62
            s += (w @ y if near else w.astype(object) @ y.astype(object)).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(dims)), "s": [str(x) for x in s], "n": [n] * dims, "most": [most] * dims}, pa.schema([("i", pa.int32()), ("s", pa.string()), ("n", pa.int64()), ("most", pa.int64())]))

    parts = classes.select("packed", "copies").mapInArrow(run, "i int, s string, n long, most long")
    told = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("i").collect()
    return (told[0]["n"], [int(r["s"]) for r in told], max(r["most"] for r in told)) if told else (0, [0] * dims, 0)


def moments(classes: DataFrame, dims: int, mean: np.ndarray, turn: np.ndarray, weighted: bool) -> np.ndarray:
    """Sum over the fit list of z z', z = (offsets - mean) turned; one upper triangle per task is summed."""
    k = turn.shape[1]
    up = np.triu_indices(k)

    def run(batches):
        total = np.zeros((k, k))
        for _, y, w in _batches(dims, batches, weighted):
            z = (y - mean) @ turn
            total += (z * w[:, None]).T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(up[0], pa.int32()), pa.array(up[1], pa.int32()), pa.array(total[up])], names=["i", "j", "v"])

    out = np.zeros((k, k))
    for i, j, v in classes.select("packed", "copies").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), largest first; an eigenvector's largest entry is positive."""
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1], u[:, ::-1]
    real = int((e > len(e) * np.finfo(float).eps * max(e[0], 0)).sum()) if e[0] > 0 else 0
    e, u = e[: min(most, real)], u[:, : min(most, real)]
    if u.size:
        u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return e, u


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row that takes part.

    ``weights`` is "one" (each distinct vector once) or "count" (as often as it occurs); n is the
    length of the fit list, deviation the sum over dimensions of (n x - S)^2, whitened the centred x
    vector on the component over the root of its eigenvalue, explained the eigenvalue's share of the
    trace, and identity_error how far the whitened fit list's covariance is from the identity.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights must be one or count, not {weights}")
    weighted = weights == "count"
    rows = whole_vectors(table, key, vector)
    classes = stored(rows.groupBy("dims", "packed").agg(F.count(F.lit(1)).alias("copies")), "classes")
    lengths = classes.groupBy("dims").agg(F.sum("copies").alias("c")).orderBy(F.desc("c"), "dims").first()
    out = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = table.sparkSession.createDataFrame([], out)
    if lengths is None:
        return none
    dims, total = lengths["dims"], lengths["c"]
    classes = classes.where(F.col("dims") == dims)
    n, s, largest = sums(classes, dims, weighted)
    mean = np.array([x / n for x in s])  # division of whole numbers, correctly rounded
    covariance = moments(classes, dims, mean, np.eye(dims), weighted) / n
    e, u = components(covariance, most)
    if not len(e):
        return none
    turn = u / np.sqrt(e)
    off = float(np.abs(moments(classes, dims, mean, turn, weighted) / n - np.eye(len(e))).max())
    fits = dims * (2 * n * largest) ** 2 < 2**63
    exact = np.array(s, np.int64 if fits else object)

    def project(batches):
        for b, y, _ in _batches(dims, batches, False):
            far = ((n * (y if fits else y.astype(object)) - exact) ** 2).sum(axis=1)
            far = [int(x) if x < 2**63 else None for x in far]
            z = (y - mean) @ turn
            yield pa.RecordBatch.from_arrays(
                [b.column("packed"), pa.array(far, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))],
                names=["packed", "deviation", "z"],
            )

    whitened = lambda part: part.select("packed", "copies").mapInArrow(project, "packed binary, deviation long, z array<double>")
    common = F.col("copies") > -(-total // HEAVY)
    heavy = F.broadcast(whitened(classes.where(common)))
    rows = rows.where(F.col("dims") == dims).select("id", "packed")
    told = rows.join(heavy, "packed").unionByName(rows.join(heavy, "packed", "left_anti").join(whitened(classes.where(~common)), "packed"))
    share = F.array(*[F.lit(float(x)) for x in e / np.trace(covariance)])
    return told.select(F.col("id").alias(key), "deviation", F.posexplode("z").alias("_at", "whitened")).select(
        key, (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("_at")].alias("explained"), F.lit(off).alias("identity_error"),
    )
