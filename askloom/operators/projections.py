"""Cosine search through sign random projections: buckets as equi-join keys, several probes, exact rerank.

Each of several tables cuts the space by a few random planes; the sides a vector lies on are its bucket.
A question asks its own bucket of every table and those across the planes it lies nearest to. What
it meets there is scored by exact cosine. Vectors that are equal are one class, of which as many keys are
kept as a search may return, so that a vector shared by a third of all rows fills no bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.operators.lexical import top_k
from askloom.operators.vectors import unit_matrix
from askloom.session import scratch_path

TABLES, BITS, PROBES = 10, 12, 12


@dataclass(frozen=True)
class Planes:
    """Random planes of all tables, the same for index and questions; they follow from the seed."""

    dim: int
    tables: int = TABLES
    bits: int = BITS
    seed: int = 7

    def sides(self, units: np.ndarray) -> np.ndarray:
        """(vector, table, bit): signed distance from each plane."""
        normals = np.random.default_rng(self.seed).normal(size=(self.dim, self.tables * self.bits))
        return (units @ normals).reshape(len(units), self.tables, self.bits)

    def buckets(self, units: np.ndarray, probes: int = 0) -> np.ndarray:
        """(vector, table, 1 + probes): own bucket, then the likeliest others by one or two sides changed."""
        sides = self.sides(units)
        weight = 1 << np.arange(self.bits, dtype=np.int64)
        own = ((sides > 0) * weight).sum(axis=2)
        if not probes:
            return own[:, :, None]
        one = [(i,) for i in range(self.bits)]
        flips = one + [(i, j) for i in range(self.bits) for j in range(i)]
        cost = np.stack([sum(sides[:, :, i] ** 2 for i in f) for f in flips], axis=2)
        mask = np.array([sum(1 << i for i in f) for f in flips], np.int64)
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
        return np.concatenate((own[:, :, None], own[:, :, None] ^ mask[best]), axis=2)


@dataclass(frozen=True)
class ProjectionIndex:
    """Stored ``buckets`` (t, bucket, class) and ``classes`` (class, v, keys), dealt by what they are joined on."""

    folder: str
    planes: Planes
    key: str
    most: int

    def table(self, spark, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def _valid(vec: str):
    v = F.col(vec)
    return (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def build(chunks: DataFrame, key: str, vec: str, dim: int, most: int = 100, folder: str | None = None, **shape) -> ProjectionIndex:
    """Indexes every vector of ``dim`` entries; zero, null and other vectors have no bucket. ``most`` bounds a search's k."""
    spark, planes = chunks.sparkSession, Planes(dim, **shape)
    folder = folder or scratch_path(spark, "projections")
    rows = chunks.where(_valid(vec) & (F.size(vec) == dim)).select(key, F.col(vec).cast("array<double>").alias("v"))
    order = Window.partitionBy("v").orderBy(key)
    few = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    few.groupBy("v").agg(F.array_sort(F.collect_list(key)).alias("keys")).select(F.xxhash64("v").alias("class"), "v", "keys").write.parquet(f"{folder}/classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = planes.buckets(unit_matrix(pa.chunked_array([b.column("v")])))[:, :, 0]
            n, t = codes.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(codes.ravel()), b.column("class").take(pa.array(np.repeat(np.arange(n), t)))],
                names=["t", "bucket", "class"],
            )

    told = spark.read.parquet(f"{folder}/classes").select("class", "v").mapInArrow(run, "t int, bucket long, class long")
    told.repartition("t", "bucket").sortWithinPartitions("t", "bucket").write.parquet(f"{folder}/buckets")
    return ProjectionIndex(folder, planes, key, most)


def candidates(index: ProjectionIndex, questions: DataFrame, qvec: str = "qvec", probes: int = PROBES) -> DataFrame:
    """(query_id, class): the classes each question meets in its own and probed buckets."""
    planes = index.planes
    rows = questions.where(_valid(qvec) & (F.size(qvec) == planes.dim)).select("query_id", F.col(qvec).cast("array<double>").alias("v"))
    kind = questions.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = planes.buckets(unit_matrix(pa.chunked_array([b.column("v")])), probes)
            n, t, p = codes.shape
            yield pa.RecordBatch.from_arrays(
                [b.column("query_id").take(pa.array(np.repeat(np.arange(n), t * p))), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(codes.ravel())],
                names=["query_id", "t", "bucket"],
            )

    asked = rows.mapInArrow(run, f"query_id {kind}, t int, bucket long")
    return asked.join(index.table(questions.sparkSession, "buckets"), ["t", "bucket"]).select("query_id", "class").distinct()


def search(index: ProjectionIndex, questions: DataFrame, k: int, qvec: str = "qvec", probes: int = PROBES) -> DataFrame:
    """(query_id, key, score, rank): the k nearest met, by exact cosine to 6 decimals, ties by key."""
    if k > index.most:
        raise ValueError(f"the index keeps {index.most} keys of equal vectors, {k} are asked for")
    met = candidates(index, questions, qvec, probes)
    held = index.table(questions.sparkSession, "classes")
    pairs = met.join(held, "class").join(questions.select("query_id", F.col(qvec).cast("array<double>").alias("q")), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, q = (unit_matrix(pa.chunked_array([b.column(c)])) for c in ("v", "q"))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("keys"), pa.array(np.round((v * q).sum(axis=1), 6) + 0.0)], names=["query_id", "keys", "score"])

    kind, keys = questions.schema["query_id"].dataType.simpleString(), held.schema["keys"].dataType.simpleString()
    scored = pairs.select("query_id", "keys", "v", "q").mapInArrow(run, f"query_id {kind}, keys {keys}, score double")
    return top_k(scored.select("query_id", F.explode("keys").alias(index.key), "score"), k, [F.desc("score"), index.key])
