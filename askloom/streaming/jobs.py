"""Stream jobs: running to completion, counters, ingestion, token streams, progress."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.functions import vector as V
from askloom.operators.chunking import child_table, parent_table
from askloom.operators.usage import count_questions, merge_counters
from askloom.session import scratch_path, settle
from askloom.streaming.stateful import STORE


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drain what is available into a table in the shared folder and read it back."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, name), scratch_path(spark, f"{name}-ckpt")
    append_to(stream, out, ckpt)
    return spark.read.schema(stream.schema).parquet(out)


def append_to(stream: DataFrame, out: str, checkpoint: str, idle_batches: bool = True) -> None:
    """One run over what is available, with keyed state in a RocksDB store; later runs go on from the checkpoint.

    ``idle_batches`` lets the run end with a batch without rows, in which event-time timers fire. State
    on the machine's clock asks for such batches without end, so it has to go without.
    """
    spark = stream.sparkSession
    wanted = dict([STORE, ("spark.sql.streaming.noDataMicroBatches.enabled", str(idle_batches).lower())])
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
            availableNow=True
        ).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _version(spark: SparkSession, folder: str, name: str, number: int, schema: str) -> DataFrame:
    """The table a batch wrote; empty before the first batch, an error if a later one is missing."""
    if number < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}={number}")


COUNTERS = "content string, count bigint, created_at timestamp, updated_at timestamp"


MANIFEST = "bucket int, version bigint"
COUNTER_BUCKETS = 64


def maintain_question_counts(asked: DataFrame, folder: str, checkpoint: str, buckets: int = COUNTER_BUCKETS):
    """Merges each micro-batch of (content, asked_at) into the counter table.

    Counters lie in buckets by the hash of their text. A batch rewrites only the buckets it has
    texts for, under its own id, and stores a manifest that names every bucket's version; a replayed batch
    starts from the manifest before and counts nothing twice. Versions that no manifest a replay could
    need names any more are removed. The number of buckets is fixed when the table is begun.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = {r["bucket"]: r["version"] for r in _version(spark, f"{folder}/manifest", "batch", batch_id - 1, MANIFEST).collect()}
        bucket = F.pmod(F.xxhash64("content"), F.lit(buckets)).cast("int").alias("bucket")
        new = settle(count_questions(batch).select("*", bucket))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        held = _buckets(spark, folder, {b: old[b] for b in touched if b in old})
        merged = merge_counters(held, new.drop("bucket")).select("*", bucket)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={batch_id}")
        now = old | {b: batch_id for b in touched}
        spark.createDataFrame(list(now.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch_id}")
        if batch_id > 1:
            before = {r["bucket"]: r["version"] for r in _version(spark, f"{folder}/manifest", "batch", batch_id - 2, MANIFEST).collect()}
            for b, v in before.items():
                if old[b] != v:  # replaced by the batch before this one, which cannot be replayed any more
                    _delete(spark, f"{folder}/data/version={v}/bucket={b}")

    return asked.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _buckets(spark: SparkSession, folder: str, versions: dict[int, int]) -> DataFrame:
    """The counters of the named buckets, each in its version."""
    if not versions:
        return spark.createDataFrame([], COUNTERS)
    return spark.read.schema(COUNTERS).parquet(*[f"{folder}/data/version={v}/bucket={b}" for b, v in versions.items()])


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of the newest manifest."""
    rows = spark.read.schema(MANIFEST + ", batch bigint").parquet(f"{folder}/manifest")
    last = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return _buckets(spark, folder, {r["bucket"]: r["version"] for r in last.collect()})


STATUS = "document_id bigint, status string, attempts int, chunks bigint"
QUEUE = "document_id bigint, text string, split_group_id string, attempts int"


def ingest_batch(
    batch: DataFrame, batch_id: int, folder: str, embed=V.hashed_embedding, dim: int = 64,
    max_attempts: int = 3, dedup: bool = True,
) -> None:
    """Chunk, embed and publish the documents of one micro-batch under its id.

    Input (document_id, text, review_status, split_group_id). Documents that fail wait in a stored
    queue, one version per batch, and are tried again with the next batch until ``max_attempts``;
    completed documents and those failed for good are skipped. Chunks, parents, statuses and queue
    of a batch are written under its id, so a replay overwrites them and half a batch is never
    visible together. Parent texts are stored once, apart from their children.
    """
    spark = batch.sparkSession
    queue = _version(spark, f"{folder}/queue", "batch", batch_id - 1, QUEUE)
    status = _read(spark, f"{folder}/status", STATUS + ", batch bigint").where(F.col("batch") < batch_id)
    over = status.where(F.col("status").isin("completed", "failed")).select("document_id")
    arrived = (
        batch.where("review_status = 'approved'").select("document_id", "text", "split_group_id").dropDuplicates(["document_id"])
        .join(over, "document_id", "left_anti")
        .join(queue.select("document_id", "attempts"), "document_id", "left")
    )
    waiting = queue.join(arrived.select("document_id"), "document_id", "left_anti")
    docs = arrived.unionByName(waiting).withColumn("attempts", (F.coalesce("attempts", F.lit(0)) + 1).cast("int"))
    docs = settle(docs)
    groups = docs.select("document_id", F.coalesce("split_group_id", F.lit("")).alias("split_group_id"))
    # cut and compared once; children and stored parents both come from what is settled here
    parents = settle(parent_table(docs.select("document_id", "text"), dedup=dedup).join(groups, "document_id").select(
        "document_id", F.concat(F.lit("p"), F.col("parent_no").cast("string")).alias("parent_id"), "parent_content", "split_group_id"
    ))
    rows = child_table(parents).withColumn("embedding", embed(F.col("child_content")))
    part = f"batch={batch_id}"
    rows.where(F.size("embedding") == dim).drop("parent_content").write.mode("overwrite").parquet(f"{folder}/chunks/{part}")
    done = spark.read.parquet(f"{folder}/chunks/{part}")
    counts = done.groupBy("document_id").agg(F.count("*").alias("chunks"))
    parents.where(~X.is_blank(F.col("parent_content"))).join(counts.select("document_id"), "document_id", "left_semi").write.mode("overwrite").parquet(
        f"{folder}/parents/{part}"
    )
    judged = docs.join(counts, "document_id", "left").withColumn(
        "status",
        F.when(F.col("chunks") > 0, "completed").when(F.col("attempts") >= max_attempts, "failed").otherwise("pending"),
    )
    judged.where("status = 'pending'").select("document_id", "text", "split_group_id", "attempts").write.mode("overwrite").parquet(
        f"{folder}/queue/{part}"
    )
    judged.select("document_id", "status", "attempts", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks")).write.mode(
        "overwrite"
    ).parquet(f"{folder}/status/{part}")


def ingest(documents: DataFrame, folder: str, checkpoint: str, **options):
    """The ingestion stream over approved documents."""
    return (
        documents.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, folder, **options))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def document_status(spark: SparkSession, folder: str) -> DataFrame:
    """Latest status of every document."""
    s = _read(spark, f"{folder}/status", STATUS + ", batch bigint")
    return s.groupBy("document_id").agg(F.max_by(F.struct("status", "attempts", "chunks"), "batch").alias("s")).select("document_id", "s.*")


# ------------------------------------------------------------------------------ token streams
def reassemble(events: DataFrame) -> DataFrame:
    """Answers out of stream events (stream_id, seq, type, content, ts).

    One stream is one answer, so its chunks are gathered whole.
    """
    chunk = F.col("type") == "chunk"
    return events.groupBy("stream_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(chunk, F.struct("seq", "content")))), lambda s: s["content"]), ""
        ).alias("answer"),
        F.count_if(chunk).alias("chunks"),
        F.min(F.when(chunk, F.col("ts"))).alias("first_chunk_at"), F.min("ts").alias("started_at"),
        F.max(F.when(F.col("type") == "done", F.col("content"))).alias("done_answer"),
    ).withColumns(
        {
            "has_done": F.col("done_answer").isNotNull(),
            "complete": F.coalesce(F.col("done_answer") == F.col("answer"), F.lit(False)),
            "first_chunk_s": F.unix_micros(F.col("first_chunk_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6,
        }
    )


def job_progress(events: DataFrame, now: Column, keep_hours: int = 24) -> DataFrame:
    """Latest state per task of (task_id, ts, stage, done, total); finished ones older than a day go.

    Percent is done over total.
    """
    last = events.groupBy("task_id").agg(F.max_by(F.struct("stage", "done", "total"), F.struct("ts", "done")).alias("s"), F.max("ts").alias("updated_at"))
    rows = last.select("task_id", "s.*", "updated_at")
    finished = F.col("stage").isin("completed", "failed")
    old = F.col("updated_at") < now - F.make_interval(hours=F.lit(keep_hours))
    return rows.where(~(finished & old)).withColumn(
        "percent", F.when(F.col("total") > 0, F.round(F.col("done") * 100.0 / F.col("total"), 1)).otherwise(0.0)
    )
