"""Corpus pipeline: the documents table through filters, near-duplicate removal and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet into the
shared folder and read again as the next stage's documents, so a lost executor costs no more than
the stage at hand. Rows without id or text pass every filter that does not reject them, those
without id are near-duplicates like others and stay behind rows with one; rows that
repeat an id count as one document; further columns of the documents are carried along; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.llm import lev_toxicity, subword_quality, superminhash
from askloom.llm.components import stored
from askloom.llm.queries import QUALITY_FROM, TOXIC_FROM, packed_documents, table
from askloom.operators.sizes import broadcast_if
from askloom.session import scratch_path

_SCORE = "_pipeline_score"


def quality(spark, docs, sf_dir):
    """Documents whose quality score is not below the classifier's threshold."""
    model = subword_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = subword_quality.score(docs, model, keep=tuple(docs.columns), out=_SCORE)
    return scored.where(F.col(_SCORE) >= QUALITY_FROM).select(*docs.columns)


def toxicity(spark, docs, sf_dir):
    """Documents whose toxicity score is below the classifier's threshold."""
    model = lev_toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = lev_toxicity.score(docs, model, keep=tuple(docs.columns), out=_SCORE)
    return scored.where(F.col(_SCORE) < TOXIC_FROM).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows without id get numbers of their own above all ids, stored so that they stay the same, and
    lose them again. The ids of the others are taken out by an anti-join, broadcast only while their
    count is bounded.
    """
    ids = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top"), F.count_if(F.col("doc_id").isNull()).alias("n")).first()
    if ids["n"]:
        number = (F.lit(ids["top"] + 1) + F.monotonically_increasing_id()).cast(docs.schema["doc_id"].dataType)
        unnamed = stored(docs.where("doc_id is null").withColumn("doc_id", number), "unnamed")
        kept = _first_of_groups(docs.where("doc_id is not null").unionByName(unnamed))
        return kept.withColumn("doc_id", F.when(F.col("doc_id") <= ids["top"], F.col("doc_id")))
    return _first_of_groups(docs)


def _first_of_groups(docs):
    gone = stored(superminhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if(gone, gone.count(), superminhash.IDS_BROADCAST), "doc_id", "left_anti").select(*docs.columns)


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of what is left, with their places in sequences of 2048 tokens."""
    return packed_documents(docs)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("packing", best_fit_packing),
]

ORACLE_SQL = None  # learned scores, signatures and byte-pair merges are beyond SQL


def run(spark, sf_dir):
    """The last stage's rows over the whole documents table of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
