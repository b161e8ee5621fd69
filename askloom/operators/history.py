"""Conversation windows under token budgets.

Messages are (session_id, turn, role, content), turns dense per session. Running sums are
computed in blocks of turns, so a very long session spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X
from askloom.operators.runs import running

SUMMARY = ("summary", "system")


def with_tokens(messages: DataFrame) -> DataFrame:
    return messages.withColumn("tokens", X.tokens_half_length(F.coalesce("content", F.lit(""))))


def needs_compression(messages: DataFrame, budget: int = K.HISTORY_BUDGET) -> DataFrame:
    return with_tokens(messages).groupBy("session_id").agg(F.sum("tokens").alias("tokens")).withColumn(
        "compress", F.col("tokens") > budget
    )


def newest_that_fit(messages: DataFrame, budget: int = K.HISTORY_BUDGET) -> DataFrame:
    """Newest messages whose tokens, summed from the end, stay within the budget.

    Tokens are not negative, so the running sum never falls and the kept rows are a suffix.
    """
    rows = running(
        with_tokens(messages), ["session_id"], "turn", {"_sum": ("sum", F.col("tokens"))}, descending=True
    )
    return rows.where(F.col("_sum") <= budget).drop("_sum")


def load_history(messages: DataFrame, budget: int = K.HISTORY_LOAD_BUDGET, summary_role: str = "summary") -> DataFrame:
    """The messages of a session from its last summary on, as many as fit the budget from the front.

    The summary's turn is a grouped maximum and the sum runs in blocks, so long sessions spread.
    """
    mark = messages.where(F.col("role") == summary_role).groupBy("session_id").agg(F.max("turn").alias("_m"))
    start = with_tokens(messages).join(mark, "session_id", "left").where(F.col("_m").isNull() | (F.col("turn") >= F.col("_m"))).drop("_m")
    rows = running(start, ["session_id"], "turn", {"_sum": ("sum", F.col("tokens"))})
    return rows.where(F.col("_sum") <= budget).drop("_sum")


def recent_turns(messages: DataFrame, n: int = 4) -> DataFrame:
    """The last n turns that are no summaries."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    normal = messages.where(~F.col("role").isin(*SUMMARY))
    return normal.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def managed_history(messages: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """History to send: unchanged below the budget, else last four turns, or summary plus last two.

    ``summaries`` is (session_id, content) written by an external model; without it the history
    is cut to recent turns.
    """
    flag = needs_compression(messages).select("session_id", "compress")
    rows = messages.join(flag, "session_id")
    short = rows.where(~F.col("compress")).drop("compress")
    long = rows.where("compress").drop("compress")
    cols = messages.columns
    if summaries is None:
        return short.unionByName(recent_turns(long, 4)).select(*cols)
    # an existing summary covers the past; sessions without one keep the newest messages that fit
    done = summaries.select("session_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), "content")
    have = summaries.select("session_id").distinct()
    with_sum = long.join(have, "session_id", "left_semi")
    cut = newest_that_fit(long.join(have, "session_id", "left_anti")).select(*cols)
    two = recent_turns(long, 2)
    n_normal = long.where(~F.col("role").isin(*SUMMARY)).groupBy("session_id").count().where("count >= 2")
    two = two.join(n_normal.select("session_id"), "session_id", "left_semi")
    summary_rows = done.join(with_sum.select("session_id").distinct(), "session_id", "left_semi")
    return short.select(*cols).unionByName(summary_rows.select(*cols)).unionByName(cut).unionByName(two.select(*cols))


def usage_estimates(answers: DataFrame) -> DataFrame:
    """input/output/total tokens: reported ones, else by script, else the last resort.

    Input (prompt, answer, input_tokens, output_tokens), reported counts null or 0 when missing.
    """
    known = F.coalesce(F.col("input_tokens") + F.col("output_tokens"), F.lit(0)) > 0
    pi, po = X.tokens_by_script(F.col("prompt")), X.tokens_by_script(F.col("answer"))
    li, lo = X.last_resort_usage(F.coalesce("answer", F.lit("")))
    est = (pi + po) > 0
    i = F.when(known, F.col("input_tokens")).when(est, pi).otherwise(li).cast("bigint")
    o = F.when(known, F.col("output_tokens")).when(est, po).otherwise(lo).cast("bigint")
    return answers.withColumns({"input_tokens": i, "output_tokens": o}).withColumn(
        "total_tokens", F.col("input_tokens") + F.col("output_tokens")
    )
