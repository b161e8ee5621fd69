"""Bounded samples of labelled documents, and the split that keeps a fifth of all ids out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: Column) -> Column:
    """Whether a document's label may never be learned from: CRC-32 of its id, as text, mod 5 is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled documents outside the held-out fold.

    Half the rows at most come from each class, those with the smallest hash of their id, so the
    sample does not depend on partitioning. Its ids are broadcast: ``rows`` bounds them.
    """
    known = (
        labels.where(F.col(target).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("id")).agg(F.max(target).cast("int").alias("label"))
    )
    halves = [
        known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(rows // 2) for c in (0, 1)
    ]
    chosen = halves[0].unionByName(halves[1])
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
