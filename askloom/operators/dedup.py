"""Near-duplicate removal inside groups: the first text of each near-copy stays.

Candidates come from two exact filters. If two sets differ in at most k elements and the hash space
is cut into k+1 parts, they agree completely in at least one part; and sets that reach the threshold
share one of their rarest elements. No pair table over a group is ever built.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X
from askloom.session import settle

BUCKET = 64  # rows of a bucket whose pairs are listed


def _signatures(threshold: float):
    ratio = (1 - threshold) / (1 + threshold)
    log_step = math.log(1 / threshold)

    @F.pandas_udf("array<bigint>")
    def signatures(hashes: pd.Series) -> pd.Series:
        def one(h):
            h = np.asarray(h, dtype=np.int64)
            n = len(h)
            if n == 0:
                return np.empty(0, dtype=np.int64)
            band = int(math.floor(math.log(n) / log_step + 1e-9))
            out = []
            for b in (band - 1, band):
                if b < 0:
                    continue
                largest = math.exp(log_step * (b + 2)) + 1
                parts = int(ratio * 2 * largest) + 1
                if parts == 1:  # only equal sets reach the threshold, and those are gone already
                    continue
                part = (h.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                mix = np.zeros(parts, dtype=np.int64)
                np.add.at(mix, part, h ^ (h >> 29))
                key = mix * np.int64(-7046029254386353131) + np.arange(parts, dtype=np.int64) * np.int64(2654435761) + np.int64(b)
                out.append(key ^ (key >> 31))
            return np.concatenate(out) if out else np.empty(0, dtype=np.int64)

        with np.errstate(over="ignore"):
            return hashes.map(one)

    return signatures


def _prefixes(texts: DataFrame, group: list[str], pos: str, threshold: float) -> DataFrame:
    """(group, pos, n, _sig) for the rarest shingles of each row; alike rows share one at least.

    Of two sets of n shingles that reach the threshold, each has at most n - ceil(threshold * n)
    shingles that the other lacks, so the first n - ceil(threshold * n) + 1 in any common order meet.
    Ordered by their counts in the group, rare ones first, they tell templated rows apart.
    """
    grams = texts.select(*group, pos, F.explode("_g").alias("_t")).withColumn("_t", F.xxhash64("_t"))
    often = settle(grams.groupBy(*group, "_t").agg(F.count("*").alias("_c")))
    n = F.size("_o")
    return (
        grams.join(often, [*group, "_t"]).groupBy(*group, pos)
        .agg(F.array_sort(F.collect_list(F.struct("_c", "_t"))).alias("_o"))  # one row's own shingles
        .select(*group, pos, n.alias("_size"), F.explode(F.slice("_o", 1, n - F.ceil(n * threshold).cast("int") + 1)).alias("_p"))
        .where("_p._c > 1")
        .select(*group, pos, "_size", F.col("_p._t").alias("_sig"))
    )


def _alike(pairs: DataFrame, texts: DataFrame, group: list[str], pos: str, threshold: float) -> DataFrame:
    """Pairs (group, _first, pos) whose full shingle sets reach the threshold."""
    return (
        pairs.join(texts, [*group, pos])
        .join(texts.select(*group, F.col(pos).alias("_first"), F.col("_g").alias("_lg")), [*group, "_first"])
        .where(X.jaccard_of_sets(F.col("_g"), F.col("_lg")) >= threshold)
        .select(*group, "_first", pos)
    )


def keep_first(
    df: DataFrame, group: list[str], pos: str, text: str, threshold: float = K.DUPLICATE_THRESHOLD
) -> DataFrame:
    """Rows of ``df`` without those that nearly repeat an earlier kept row of their group.

    Texts too short for a trigram are never duplicates. Candidates share a part signature and then
    one of their rarest shingles; the pairs of buckets of at most ``BUCKET`` rows are confirmed once
    and written as links. Rounds go over links alone, and over the few larger buckets: a row without
    an earlier undecided neighbour is kept and drops its near-copies.
    """
    grams = X.shingles(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(*group, pos, grams.alias("_g")).where(F.size("_g") > 0).select(
        *group, pos,
        F.md5(F.array_join(F.sort_array("_g"), "\u0001")).alias("_set"),
        _signatures(threshold)(F.transform("_g", lambda g: F.xxhash64(g))).alias("_sigs"),
    )
    # three branches read the signatures; they are far smaller than the texts, so write them once
    rows = settle(rows)
    # equal sets first: everything but the first of them drops, whatever happens to the first
    firsts = rows.groupBy(*group, "_set").agg(
        F.min(pos).alias(pos), F.min_by("_sigs", pos).alias("_sigs"), F.count("*").alias("_n")
    )
    sigs = firsts.select(*group, pos, F.explode(F.array_distinct("_sigs")).alias("_sig"))
    size = sigs.groupBy(*group, "_sig").agg(F.count("*").alias("_n")).where("_n > 1")
    wanted = settle(sigs.join(size.drop("_n"), [*group, "_sig"], "left_semi").select(*group, pos).distinct())
    copies = rows.join(firsts.where("_n > 1").select(*group, "_set", F.col(pos).alias("_first")), [*group, "_set"]).where(
        F.col(pos) != F.col("_first")
    ).select(*group, pos)
    if wanted.isEmpty():
        return df.join(copies, [*group, pos], "left_anti")
    # only texts that share a signature are fetched again
    texts = settle(df.join(wanted, [*group, pos], "left_semi").select(*group, pos, grams.alias("_g")))
    parts = settle(_prefixes(texts, group, pos, threshold))
    sizes = parts.groupBy(*group, "_sig").agg(F.count("*").alias("_n")).where("_n > 1")
    parts = settle(parts.join(sizes, [*group, "_sig"]))
    listed = parts.where(F.col("_n") <= BUCKET).groupBy(*group, "_sig").agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col("_size").alias("n")))).alias("_m")
    )
    pairs = listed.select(*group, F.explode(F.flatten(F.transform("_m", lambda x, i: F.transform(
        F.filter(F.slice("_m", i + 2, F.size("_m")), lambda y: F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"])),
        lambda y: F.struct(x["pos"].alias("x"), y["pos"].alias("y")),
    )))).alias("_e")).select(*group, F.col("_e.x").alias("_first"), F.col("_e.y").alias(pos)).distinct()
    links = settle(_alike(pairs, texts, group, pos, threshold))
    large = settle(parts.where(F.col("_n") > BUCKET).select(*group, pos, "_sig"))
    gone = copies
    while not (links.isEmpty() and large.isEmpty()):
        pivot = large.groupBy(*group, "_sig").agg(F.min(pos).alias("_first"))
        seen = settle(large.join(pivot, [*group, "_sig"]).select(*group, pos, "_first").distinct())
        later = links.select(*group, pos).unionByName(seen.where(F.col(pos) != F.col("_first")).select(*group, pos))
        every = later.unionByName(links.select(*group, F.col("_first").alias(pos))).unionByName(seen.select(*group, pos))
        leaders = settle(every.distinct().join(later.distinct(), [*group, pos], "left_anti").withColumnRenamed(pos, "_first"))
        near = _alike(
            seen.where(F.col(pos) != F.col("_first")).join(leaders, [*group, "_first"], "left_semi"), texts, group, pos, threshold
        )
        out = settle(links.join(leaders, [*group, "_first"], "left_semi").unionByName(near).select(*group, pos).distinct())
        done = leaders.withColumnRenamed("_first", pos).unionByName(out).distinct()
        open_ends = links.join(done, [*group, pos], "left_anti").join(done.withColumnRenamed(pos, "_first"), [*group, "_first"], "left_anti")
        links = settle(open_ends.select(*group, "_first", pos))
        large = settle(large.join(done, [*group, pos], "left_anti"))
        gone = gone.unionByName(out)
    return df.join(gone, [*group, pos], "left_anti")


def exact_first(df: DataFrame, text: str, order: str) -> DataFrame:
    """First row of every exact text, keyed by its md5, with the number of copies."""
    return df.withColumn("content_key", X.content_key(F.col(text))).groupBy("content_key").agg(
        F.min(order).alias(order), F.count("*").alias("copies")
    )
