"""Event-time windows over a stream: tumbling, sliding and session windows, late rows kept apart.

Spark drops rows behind the watermark without a trace. Here a first query deals every micro-batch
into rows that are in time and rows that are late, by the watermark that the batches before it have
set, and stores both; the windows read only the first kind, under the same delay, so that nothing more
is dropped. A stream that has come to its end is closed by one heartbeat row, which moves the watermark
past the last window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from askloom.session import scratch_path

NEWEST = "newest_us bigint"


def _newest(spark: SparkSession, folder: str, batch_id: int) -> int | None:
    """Newest event time, in microseconds, of the batches up to one; an error if a past batch left none."""
    if batch_id < 0:
        return None
    return spark.read.schema(NEWEST).parquet(f"{folder}/newest/batch={batch_id}").first()["newest_us"]


def deal_batch(batch: DataFrame, batch_id: int, folder: str, delay_s: int, ts: str = "ts") -> None:
    """Stores one micro-batch under its id: ``late=false`` rows, ``late=true`` rows, newest event time.

    A row is late when its event time is more than the delay behind the newest one of the batches
    before, or when it has none. A replayed batch overwrites what it wrote, so kept and late rows
    together are always the rows that came in.
    """
    spark = batch.sparkSession
    newest = _newest(spark, folder, batch_id - 1)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    late = at.isNull() if newest is None else at.isNull() | (at < newest - delay_s * 1_000_000)
    path = f"{folder}/rows/batch={batch_id}"
    batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(path)
    seen = spark.read.schema(batch.schema).parquet(path).agg(F.max(at).alias("newest_us"))
    known = F.greatest("newest_us", F.lit(newest).cast("bigint"))
    seen.select(known.alias("newest_us")).write.mode("overwrite").parquet(f"{folder}/newest/batch={batch_id}")


def deal(events: DataFrame, folder: str, checkpoint: str, delay_s: int, ts: str = "ts"):
    """The dealing query over what has arrived; returns the running query."""
    return (
        events.writeStream.foreachBatch(lambda df, i: deal_batch(df, i, folder, delay_s, ts))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def late_rows(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The side table: every late row with the batch it came in."""
    return _dealt(spark, folder, schema).where("late").drop("late")


def _dealt(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    full = StructType(schema.fields).add("batch", LongType()).add("late", BooleanType())
    return spark.read.schema(full).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def in_time(spark: SparkSession, folder: str, schema: StructType, **options) -> DataFrame:
    """The rows in time as a stream; ``options`` such as maxFilesPerTrigger bound its micro-batches."""
    return spark.readStream.schema(schema).options(**options).parquet(f"{folder}/rows/batch=*/late=false")


def close(spark: SparkSession, folder: str, schema: StructType, after_s: int, ts: str = "ts") -> None:
    """Stores a heartbeat ``after_s`` behind the newest event: a row with a time and nothing else.

    ``after_s`` has to exceed the delay and the longest window. Its own window never closes.
    """
    batches = spark.read.schema(NEWEST + ", batch bigint").parquet(f"{folder}/newest")
    last = batches.agg(F.max_by("newest_us", "batch").alias("us"), F.max("batch").alias("b")).first()
    if last["us"] is None:
        return
    beat = spark.range(1).select(
        *[(F.timestamp_micros(F.lit(last["us"] + after_s * 1_000_000)) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    beat.write.mode("overwrite").parquet(f"{folder}/rows/batch={last['b'] + 1}/late=false")


def tumbling(events: DataFrame, width: str, keys: list[str], aggregates: list[Column], ts: str = "ts") -> DataFrame:
    """One row per key and window of fixed width."""
    return _flat(events.groupBy(*keys, F.window(ts, width).alias("_w")).agg(*aggregates), keys)


def sliding(events: DataFrame, width: str, slide: str, keys: list[str], aggregates: list[Column], ts: str = "ts") -> DataFrame:
    """One row per key and overlapping window; a row counts in width / slide of them."""
    return _flat(events.groupBy(*keys, F.window(ts, width, slide).alias("_w")).agg(*aggregates), keys)


def sessions(events: DataFrame, gap: str, keys: list[str], aggregates: list[Column], ts: str = "ts") -> DataFrame:
    """One row per key and run of events with no pause as long as ``gap``; a session ends one gap after its last."""
    return _flat(events.groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(*aggregates), keys)


def _flat(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in rows.columns if c not in (*keys, "_w")])


def windows_to_table(spark: SparkSession, folder: str, schema: StructType, delay_s: int, make, name: str, ts: str = "ts", **options) -> DataFrame:
    """Runs ``make(stream)`` over the rows in time and returns the windows that have closed.

    Sessions are merged inside each task before the shuffle, so that the events of a key with very
    many move as sessions.
    """
    merge = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(merge, "false")
    spark.conf.set(merge, "true")
    try:
        out = scratch_path(spark, name)
        stream = make(in_time(spark, folder, schema, **options).withWatermark(ts, f"{delay_s} seconds"))
        query = (
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, f"{name}-ckpt"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(merge, before)
    return spark.read.schema(stream.schema).parquet(out)
