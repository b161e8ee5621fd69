"""Readers and writers: relational tables, text files, golden sets, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom import constants as K
from askloom import schemas as S
from askloom.functions import text as X
from askloom.operators.runs import running


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_declared(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A relational table with its declared schema (no inference)."""
    return spark.read.schema(S.TABLES[table]).parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options
) -> DataFrame:
    """A relational table over JDBC, read in ``parts`` key ranges at once."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high,
            numPartitions=parts, **options,
        )
        .load()
    )


# ------------------------------------------------------------------------------ files
def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def admit_files(files: DataFrame) -> DataFrame:
    """Adds ``ext``, ``valid``, ``error`` and ``route`` to a file listing (path, length).

    Only ``path`` and ``length`` are read, so a ``binaryFile`` listing never loads contents here.
    """
    ext = extension(F.col("path"))
    error = (
        F.when(F.col("length") > K.MAX_FILE_BYTES, "file too large")
        .when(ext.isin(K.BANNED_EXTENSIONS), "spreadsheet not supported")
        .when(~ext.isin(K.ALLOWED_EXTENSIONS), "format not supported")
    )
    return files.select(
        "*",
        ext.alias("ext"),
        error.isNull().alias("valid"),
        error.alias("error"),
        F.when(F.col("length") > K.LARGE_FILE_BYTES, "split").otherwise("whole").alias("route"),
    )


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8, else GBK, else Latin-1."""

    @F.pandas_udf("string")
    def gbk(raw: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                return bytes(b).decode("gbk")
            except UnicodeDecodeError:
                return None

        return raw.map(one)

    # The UDF gets null for the usual UTF-8 file, so its bytes never leave the JVM.
    valid = F.is_valid_utf8(content.cast("string"))
    other = F.when(~valid, content)
    return F.when(valid, F.decode(content, "UTF-8")).otherwise(
        F.coalesce(gbk(other), F.decode(content, "ISO-8859-1"))
    )


def read_text_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length, text) of admitted txt and md files."""
    files = spark.read.format("binaryFile").load(glob)
    admitted = admit_files(files).where(F.col("valid") & F.col("ext").isin(".txt", ".md"))
    return admitted.select("path", "length", "route", decode_text(F.col("content")).alias("text"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.GOLDEN).json(path)


def golden_subset(golden: DataFrame, difficulty: str | None = None, category: str | None = None):
    out = golden
    if difficulty is not None:
        out = out.where(F.col("difficulty") == difficulty)
    if category is not None:
        out = out.where(F.col("category") == category)
    return out


# ------------------------------------------------------------------------------ sinks
def write_report(details: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluation report: per-question detail and a one-row summary, both as JSON."""
    details.write.mode("overwrite").json(f"{path}/details")
    summary.write.mode("overwrite").json(f"{path}/summary")


def append_messages(messages: DataFrame, path: str) -> None:
    message_rows(messages).write.mode("append").parquet(path)


def message_rows(messages: DataFrame) -> DataFrame:
    """Conversation messages with their structured columns as JSON text."""
    as_json = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.col(c))).alias(c)
    structured = [c for c in ("sources", "features", "token_usage") if c in messages.columns]
    return messages.select(
        *[as_json(c) if c in structured else F.col(c) for c in messages.columns]
    )


def child_rows(chunks: DataFrame, embeddings: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) child-vector rows of chunks joined with their embeddings.

    Texts are stored whole; the group id defaults to ''.
    """
    rows = chunks.join(embeddings, ["document_id", "child_id"], "left").select(
        F.concat(F.lit("doc"), F.col("document_id"), F.lit("_"), F.col("child_id")).alias("id"),
        "document_id", "parent_id", "child_id", "child_content",
        F.coalesce(F.col("split_group_id"), F.lit("")).alias("split_group_id"),
        "embedding",
        F.when(F.col("embedding").isNull() | (F.size("embedding") == 0), "no vector")
        .when(F.size("embedding") != dim, "wrong dimension")
        .alias("reject_reason"),
    )
    good = F.col("reject_reason").isNull()
    return rows.where(good).drop("reject_reason"), rows.where(~good)


def parent_rows(chunks: DataFrame) -> DataFrame:
    """First row of each (document, parent) with non-blank text."""
    return (
        chunks.where(~X.is_blank(F.col("parent_content")))
        .groupBy("document_id", "parent_id")
        .agg(
            F.min_by("parent_content", "child_no").alias("parent_content"),
            F.min_by(F.coalesce(F.col("split_group_id"), F.lit("")), "child_no").alias("split_group_id"),
        )
    )


def page_batches(pages: DataFrame, size: int = 5) -> DataFrame:
    """Every ``size`` non-blank pages of a document joined by blank lines.

    Input (doc_id, page_no, text). Page positions come from a per-document count of non-blank
    pages; batches are bounded, so no group grows with the document.
    """
    rows = running(
        pages.where(~X.is_blank(F.col("text"))), ["doc_id"], "page_no", {"_n": ("sum", F.lit(1))}
    )
    return (
        rows.withColumn("batch_no", F.floor((F.col("_n") - 1) / size))
        .groupBy("doc_id", "batch_no")
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
        .select("doc_id", "batch_no", F.array_join(F.col("p.text"), "\n\n").alias("text"))
    )
