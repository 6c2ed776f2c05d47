"""Sides of joins that are small by nature, but come from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules, classes and document types are broadcast up to so many rows.
SMALL_ROWS = 10_000


def if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most SMALL_ROWS rows; beyond that, Spark chooses the join."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


#: Above MANY rows a table is dealt to so many tasks that each sorts about A_TASK of them, whatever the session's number of partitions.
MANY, A_TASK = 1_000_000, 100_000


def tasks(rows: DataFrame) -> int | None:
    """To how many tasks ``rows`` are to be dealt; null where Spark may choose."""
    n = rows.count()
    return -(-n // A_TASK) if n > MANY else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` by hash of ``keys`` on ``n`` tasks, which are not merged again."""
    return df if n is None else df.repartition(n, *keys)
