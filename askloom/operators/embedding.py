"""Bookkeeping around an external embedding model: backlog, batches, checks, order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.functions import text as X


def backlog(texts: DataFrame, cache: DataFrame, model: str, dim: int, text: str = "text") -> DataFrame:
    """Distinct non-blank texts without a stored vector for this model and dimension."""
    keyed = (
        texts.where(~X.is_blank(F.col(text)))
        .withColumn("content_key", X.content_key(F.col(text)))
        .groupBy("content_key").agg(F.any_value(text).alias(text))
    )
    have = cache.where((F.col("model") == model) & (F.col("dim") == dim)).select("content_key")
    return keyed.join(have, "content_key", "left_anti")


def attach(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Vectors by content; blank texts get an empty vector, unknown ones null. Rows keep their keys."""
    keyed = texts.withColumn("content_key", X.content_key(F.col(text)))
    joined = keyed.join(cache.select("content_key", "embedding"), "content_key", "left")
    empty = F.array().cast("array<float>")
    return joined.withColumn(
        "embedding", F.when(X.is_blank(F.col(text)), empty).otherwise(F.col("embedding"))
    )


def check_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Adds ``problem``: null, missing, empty or wrong dimension."""
    size = F.size("embedding")
    return vectors.withColumn(
        "problem",
        F.when(F.col("embedding").isNull(), "missing").when(size == 0, "empty").when(size != dim, "dimension"),
    )


def request_batches(backlog_rows: DataFrame, size: int = 10) -> DataFrame:
    """(keys, texts): requests of at most ``size`` texts for an external caller.

    Each task cuts its own rows into requests as they pass; no row leaves its partition.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = pa.array([*range(0, b.num_rows, size), b.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(off, b.column(c)) for c in ("content_key", "text")]
            yield pa.RecordBatch.from_arrays(lists, names=["keys", "texts"])

    rows = backlog_rows.select("content_key", "text")
    return rows.mapInArrow(cut, "keys array<string>, texts array<string>")


def numbered_batches(rows: DataFrame, order: str, size: int = 10) -> DataFrame:
    """Batch number by position, where the caller already has dense positions."""
    return rows.withColumn("batch_no", F.floor(F.col(order) / size).cast("bigint"))
