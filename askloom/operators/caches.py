"""Answer and question caches as tables."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructType

from askloom import constants as K
from askloom.functions import text as X
from askloom.operators import vectors as VS
from askloom.operators.answers import cacheable
from askloom.operators.runs import running
from askloom.operators.sizes import broadcast_if
from askloom.session import settle


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def reuse_exact(asked: DataFrame, stored: DataFrame, ttl_s: int = K.TTL_ANSWER_S, text: str = "question") -> DataFrame:
    """For each asked question the newest stored entry with the same text that has not expired.

    ``asked`` is (ask_id, question, asked_at), ``stored`` (entry_id, question, stored_at). An as-of join
    without pairs: both logs in one time line per text, the latest entry carried forward in blocks
    of one TTL, so a hot text stays linear and spreads over tasks.
    """
    key = X.content_key(F.col(text)).alias("_k")
    a = asked.select(key, _micros("asked_at").alias("_us"), F.lit(1).alias("_kind"), "ask_id", F.lit(None).cast(stored.schema["entry_id"].dataType).alias("_e"))
    s = stored.select(key, _micros("stored_at").alias("_us"), F.lit(0).alias("_kind"), F.lit(None).cast(asked.schema["ask_id"].dataType).alias("ask_id"), F.col("entry_id").alias("_e"))
    entry = F.when(F.col("_kind") == 0, F.struct("_us", "_e"))
    line = running(
        a.unionByName(s), ["_k"], "_us", {"_last": ("max", entry)}, block=ttl_s * 1_000_000, ties=["_kind"]
    )
    fresh = F.col("_us") < F.col("_last._us") + ttl_s * 1_000_000
    found = line.where("_kind = 1").select("ask_id", F.when(fresh, F.col("_last._e")).alias("entry_id"))
    return asked.join(found, "ask_id").withColumn("hit", F.col("entry_id").isNotNull())


def latest_before(
    log: DataFrame, key: str, at: str, ident: str, ttl_s: int = K.TTL_ANSWER_S
) -> DataFrame:
    """Self-reuse of a log: the previous ask of the same key, if it is younger than the TTL."""
    rows = log.withColumn("_us", _micros(at))
    prev = running(
        rows, [key], "_us", {"_p": ("max", F.struct("_us", ident))}, include_current=False,
        block=ttl_s * 1_000_000, ties=[ident],
    )
    ok = F.col("_us") < F.col("_p._us") + ttl_s * 1_000_000
    return prev.withColumn("entry_id", F.when(ok, F.col(f"_p.{ident}"))).drop("_p", "_us")


SIDE_ROWS = 4096  # asks, or entries, of one time bucket that meet as one block


def reuse_similar(
    asked: DataFrame, stored: DataFrame, threshold: float = K.SEMANTIC_CACHE_THRESHOLD,
    ttl_s: int = K.TTL_EMBEDDING_S, vec: str = "embedding",
) -> DataFrame:
    """The most similar earlier question at or above the threshold, the first stored on ties.

    ``asked`` is (ask_id, asked_at, vector), ``stored`` (entry_id, stored_at, vector). Time is cut into
    buckets as wide as an entry's life: an ask can only be answered out of its own bucket and the one
    before, so these are an equi-join key, and asks never meet entries of other times. Inside a
    bucket, blocks of asks meet blocks of entries, and one row an ask leaves each pair of blocks.
    """
    life = ttl_s * 1_000_000
    bucket = lambda us: F.floor(us / F.lit(life)).cast("bigint")
    unit = lambda c: F.col(c).cast("array<double>").alias("v")
    asks = asked.select("ask_id", _micros("asked_at").alias("us"), unit(vec)).where(F.size("v") > 0)
    asks = asks.withColumn("bucket", F.explode(F.array(bucket(F.col("us")), bucket(F.col("us")) - 1)))
    held = stored.select("entry_id", _micros("stored_at").alias("us"), unit(vec)).where(F.size("v") > 0).withColumn("bucket", bucket(F.col("us")))
    count = lambda df, n: df.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SIDE_ROWS).cast("bigint").alias(n))
    both = settle(count(asks, "na").join(count(held, "ns"), "bucket"))
    near = broadcast_if(both, both.count())
    left = asks.join(near, "bucket").select("bucket", F.pmod(F.xxhash64("ask_id"), "na").alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ns") - 1)).alias("y"), "ask_id", "us", "v")
    right = held.join(near, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("na") - 1)).alias("x"), F.pmod(F.xxhash64("entry_id"), "ns").alias("y"), "entry_id", "us", "v")
    kinds = StructType([asked.schema["ask_id"], stored.schema["entry_id"]]).add("us", LongType()).add("similarity", DoubleType())
    empty = to_arrow_schema(kinds).empty_table()

    def run(a: pa.Table, s: pa.Table) -> pa.Table:
        if not len(a) or not len(s):
            return empty
        first = np.lexsort((np.argsort(np.argsort(np.array(s.column("entry_id").to_pylist(), object))), s.column("us").to_numpy()))
        s = s.take(pa.array(first))
        at, stored_at = a.column("us").to_numpy(), s.column("us").to_numpy()
        m, n = VS.unit_matrix(a.column("v")), VS.unit_matrix(s.column("v"))
        if m.shape[1] != n.shape[1]:
            return empty
        near = np.round(m @ n.T, 6)
        near[~((stored_at[None, :] < at[:, None]) & (at[:, None] < stored_at[None, :] + life)) | (near < threshold)] = -np.inf
        best = near.argmax(axis=1)  # the first of equal ones: entries lie by time, then id
        found = np.flatnonzero(near[np.arange(len(near)), best] > -np.inf)
        s = s.take(pa.array(best[found]))
        return pa.table([a.column("ask_id").take(pa.array(found)), s.column("entry_id"), s.column("us"), pa.array(near[found, best[found]])], schema=empty.schema)

    keys = ["bucket", "x", "y"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, kinds)
    best = met.groupBy("ask_id").agg(F.min_by(F.struct("entry_id", "similarity"), F.struct(-F.col("similarity"), "us", "entry_id")).alias("b"))
    return asked.join(best.select("ask_id", "b.entry_id", "b.similarity"), "ask_id", "left")


def newest_entries(entries: DataFrame, cap: int = K.SEMANTIC_CACHE_SIZE) -> DataFrame:
    """The ``cap`` keys stored first most recently; overwriting a key keeps its place.

    Entries are combined per key first; the global top is a take-ordered, not a window.
    """
    first = entries.groupBy("content_key").agg(
        F.min("stored_at").alias("first_stored"), F.max("stored_at").alias("last_stored"), F.max_by("entry_id", "stored_at").alias("entry_id")
    )
    return first.orderBy(F.desc("first_stored"), "content_key").limit(cap)


def storable(answers: DataFrame) -> DataFrame:
    return answers.where((F.col("confidence") == "高") & cacheable(F.col("answer")))


def purge(entries: DataFrame, now: Column, cap: int) -> DataFrame:
    """Unexpired entries; above the cap those that expire soonest go first (no expiry goes before)."""
    alive = entries.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))
    return alive.orderBy(F.desc_nulls_last("expire_at"), F.desc("key")).limit(cap)


def invalidate(entries: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    """Entries whose key does not match a glob such as ``search:*``."""
    regex = "^" + ".*".join(re.escape(p) for p in pattern.split("*")).replace(r"\?", ".") + "$"
    return entries.where(~F.col(key).rlike("(?s)" + regex))
