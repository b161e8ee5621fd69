"""Connected components of a table of links: union-find inside tasks, alternating stars between them.

Every pass is two grouped minima and joins over the links alone; nothing is gathered on the driver
but two numbers that tell whether the links still change.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _forest(batches):
    """Union-find over one task's links: each node with the smallest node it reaches there."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in root if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"]
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node."""
    now = stored(links.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), "links")
    seen = None
    while True:
        told = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if told == seen or not told["n"]:
            break
        seen = told
        # Large star: larger neighbours move to the smallest. The minima are stored, so both sides of
        # each join are plain exchanges and a node with very many links can be split.
        low = stored(
            _both(now).groupBy("a").agg(F.min("b").alias("m")).where("m < a").select(F.col("a").alias("b"), "m"), "low"
        )
        large = now.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).where("a <> b").distinct()
        large = stored(large, "large")
        # Small star: smaller neighbours move too.
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        moved = large.join(low.where("n > 1"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(low.select("a", F.col("m").alias("b")).unionByName(moved).distinct(), "links")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
