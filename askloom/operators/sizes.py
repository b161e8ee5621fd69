"""Broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 65_536


def broadcast_if(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when its counted rows stay below the limit.

    Beyond it the side is left unmarked, and the join shuffles on its key.
    """
    return F.broadcast(df) if rows <= limit else df
