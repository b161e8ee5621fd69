"""Consistency of the index tables with the relational ones, deletes and rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def delete_rows(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def drop_invalid_vectors(vectors: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(valid rows, one row with the number removed): ids must be positive."""
    good = F.col(key) > 0
    return vectors.where(good), vectors.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("removed"))


def vectors_per_document(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("document_id").agg(F.count("*").alias("vectors"))


def consistency(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(document_id, problem): ids only in the vectors (orphan) or only in the documents (missing)."""
    d, v = documents.select("document_id").distinct(), vectors.select("document_id").distinct()
    orphan = v.join(d, "document_id", "left_anti").withColumn("problem", F.lit("orphan"))
    missing = d.join(v, "document_id", "left_anti").withColumn("problem", F.lit("missing"))
    return orphan.unionByName(missing)


def consistency_report(problems: DataFrame) -> DataFrame:
    return problems.agg(
        F.count_if(F.col("problem") == "orphan").alias("orphans"), F.count_if(F.col("problem") == "missing").alias("missing")
    ).withColumn("is_consistent", (F.col("orphans") == 0) & (F.col("missing") == 0))


def parent_integrity(parents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(document_id, parent_id, problem) of pairs on one side only."""
    key = ["document_id", "parent_id"]
    p = parents.select(*key).distinct().withColumn("_p", F.lit(1))
    v = vectors.select(*key).distinct().withColumn("_v", F.lit(1))
    return p.join(v, key, "full_outer").where("_p is null or _v is null").select(
        *key, F.when(F.col("_p").isNull(), "no parent row").otherwise("no vectors").alias("problem")
    )


def clean_orphans(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    return vectors.join(documents.select("document_id").distinct(), "document_id", "left_semi")


def cascade_delete(users_gone: DataFrame, sessions: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) without those of deleted users."""
    lost = sessions.join(users_gone.select("user_id").distinct(), "user_id", "left_semi").select(F.col("id").alias("session_id"))
    return (
        sessions.join(users_gone.select("user_id").distinct(), "user_id", "left_anti"),
        messages.join(lost, "session_id", "left_anti"),
    )


POINTER = "version string, documents bigint"


def rebuild(documents: DataFrame, chunk, embed: Column, dim: int, path: str, version: str) -> DataFrame:
    """Rebuild all vectors under a new version; one row saying how it went and which version is active.

    ``chunk`` turns documents (document_id, text) into chunks; ``embed`` is the vector expression. Chunks
    with their vectors go to a folder of the version in one pass, the documents that have none or a
    wrong one to a table beside it. Only while that table is empty is the pointer moved: a new row in
    a folder numbered one higher, so that readers see the old version or the new one and nothing between.
    """
    spark = documents.sparkSession
    target = f"{path}/vectors/version={version}"
    chunk(documents).withColumn("embedding", embed).write.mode("overwrite").parquet(target)
    good = spark.read.parquet(target).groupBy("document_id").agg(F.min(F.size("embedding") == dim).alias("ok"))
    state = documents.select("document_id").distinct().join(good, "document_id", "left").select("document_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    failed = f"{path}/failed/version={version}"
    state.where("not ok").select("document_id").write.mode("overwrite").parquet(failed)
    lost, total = spark.read.parquet(failed).count(), documents.select("document_id").distinct().count()
    if not lost:
        number = len(_pointers(spark, path)) + 1
        spark.createDataFrame([(version, total)], POINTER).coalesce(1).write.parquet(f"{path}/pointer/n={number}")
    return spark.createDataFrame([(total, lost, active_version(spark, path))], "documents bigint, failed bigint, active_version string")


def _pointers(spark: SparkSession, path: str) -> list:
    """The pointer's rows, oldest first; one per completed rebuild."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointer")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return []
    return spark.read.schema(POINTER + ", n int").parquet(f"{path}/pointer").orderBy("n").collect()


def active_version(spark: SparkSession, path: str) -> str | None:
    """The version the pointer names; none before the first complete rebuild."""
    rows = _pointers(spark, path)
    return rows[-1]["version"] if rows else None


def active_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The chunks and vectors of the active version."""
    version = active_version(spark, path)
    if version is None:
        raise ValueError(f"no complete version in {path}")
    return spark.read.parquet(f"{path}/vectors/version={version}").withColumn("version", F.lit(version))


def failed_documents(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The documents a rebuild could not complete."""
    return spark.read.schema("document_id bigint").parquet(f"{path}/failed/version={version}")
