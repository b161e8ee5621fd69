"""Greedy, order-dependent packing written as ``aggregate`` folds over one row's array.

The array is the text of one row, already split, so a fold never holds more than that row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` over a value computed once; an expression used twice would be evaluated twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _start() -> Column:
    return F.struct(
        F.array().cast("array<string>").alias("done"),
        F.array().cast("array<string>").alias("buf"),
        F.lit(0).cast("bigint").alias("size"),
    )


def _state(done: Column, buf: Column, size: Column) -> Column:
    return F.struct(done.alias("done"), buf.alias("buf"), size.cast("bigint").alias("size"))


def _flush(acc: Column, sep: str) -> Column:
    return F.when(
        F.size(acc["buf"]) > 0,
        F.concat(acc["done"], F.array(F.array_join(acc["buf"], sep))),
    ).otherwise(acc["done"])


def pack(units: Column, limit: int, sep: str = "\n\n") -> Column:
    """Append units to a block until the next one would pass ``limit`` characters.

    Separators are not counted, and a unit longer than the limit makes a block of its own.
    """

    def step(acc: Column, u: Column) -> Column:
        full = (acc["size"] + F.length(u) > limit) & (F.size(acc["buf"]) > 0)
        return F.when(
            full, _state(_flush(acc, sep), F.array(u), F.length(u))
        ).otherwise(_state(acc["done"], F.concat(acc["buf"], F.array(u)), acc["size"] + F.length(u)))

    return F.aggregate(units, _start(), step, lambda acc: _flush(acc, sep))


def merge_tiny(blocks: Column, tiny: int = 100, limit: int = 1500, sep: str = "\n\n") -> Column:
    """Join runs of blocks shorter than ``tiny`` while the joined size stays below ``limit``."""

    def step(acc: Column, b: Column) -> Column:
        small = F.length(b) < tiny
        return (
            F.when(
                small & (acc["size"] + F.length(b) < limit),
                _state(acc["done"], F.concat(acc["buf"], F.array(b)), acc["size"] + F.length(b)),
            )
            .when(small, _state(_flush(acc, sep), F.array(b), F.length(b)))
            .otherwise(
                _state(
                    F.concat(_flush(acc, sep), F.array(b)),
                    F.array().cast("array<string>"),
                    F.lit(0),
                )
            )
        )

    return let(
        blocks,
        lambda all_: F.when(F.size(all_) <= 1, all_).otherwise(
            F.aggregate(all_, _start(), step, lambda acc: _flush(acc, sep))
        ),
    )
