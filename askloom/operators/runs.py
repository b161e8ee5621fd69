"""Running values inside long ordered groups, computed in blocks.

A plain window would sort a whole group in one task. Here positions are cut into blocks: block
totals are pre-aggregated, prefixed over the few blocks of a group, and added to a window that
only spans one block, so a document or session holding a third of all rows spreads over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    if kind == "max":
        return F.greatest(a, b)
    return F.least(a, b)


def running(
    df: DataFrame, group: list[str], pos: str, values: dict[str, tuple[str, Column]],
    include_current: bool = True, descending: bool = False, block: int = 4096,
    ties: list[str] | None = None,
) -> DataFrame:
    """Adds, for each name, the running ``sum``/``max``/``min`` of a column in position order.

    ``pos`` is an integer position (or a time in microseconds, with ``block`` a span of time); rows
    that share a position follow the ``ties`` columns. ``max`` and ``min`` also work on structs
    led by the position, which carries the last or first value forward; nulls are passed over.
    """
    order = F.desc if descending else F.asc
    rows = df.withColumn("_b", F.floor(F.col(pos) / block))
    for name, (_, value) in values.items():
        rows = rows.withColumn(f"_v_{name}", value)
    by_block = Window.partitionBy(*group).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*group, "_b").agg(
        *[_AGG[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in values.items()]
    )
    carry = carry.select(
        *group, "_b",
        *[_AGG[kind](f"_t_{n}").over(by_block).alias(f"_c_{n}") for n, (kind, _) in values.items()],
    )
    inside = Window.partitionBy(*group, "_b").orderBy(order(pos), *(ties or [])).rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1
    )
    for n, (kind, _) in values.items():
        rows = rows.withColumn(f"_w_{n}", _AGG[kind](f"_v_{n}").over(inside))
    # null-safe on the group so that rows with null keys keep their own running values
    left, right = rows.alias("l"), carry.alias("r")
    on = reduce(
        lambda a, c: a & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), [*group, "_b"], F.lit(True)
    )
    return left.join(right, on, "left").select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[
            _combine(kind, F.col(f"l._w_{n}"), F.col(f"r._c_{n}")).alias(n)
            for n, (kind, _) in values.items()
        ],
    )
