"""Broadcasting behind a check of the size, and tasks by counts of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise

#: Rows of a layout, a bin table or a request that are small enough for every executor.
BROADCAST_ROWS = 500_000
#: Rows of a task where rows are dealt by their count.
TASK_ROWS = 500_000


def fits(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` has at most ``limit`` rows, by default those of a broadcast."""
    limit = BROADCAST_ROWS if limit is None else limit
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else with one that joins shuffle it."""
    return F.broadcast(df) if fits(df, limit) else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a hint that joins shuffle it.

    For rows made by ``explode``: Spark takes them to be as many as the rows that they come from, and so would collect millions
    of bins of a small table on the driver to broadcast them. The other side of a join may still be broadcast.
    """
    return df.hint("merge")


def small_once(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """``df`` written to the shared folder, so that several joins and the check of its size compute it once."""
    return small(materialise(df, name), limit)


def dealt(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """``df`` shuffled by ``key`` to as many tasks as ``rows``, about the number of its rows, asks for.

    AQE joins partitions until they hold 64 MB: of narrow rows these are millions, which one task would sort and aggregate.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *key)


def meet(left: DataFrame, right: DataFrame, key: list[str], few: bool, rows: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which is broadcast if it has ``few`` rows (see ``fits``) and else shuffled.

    With ``rows``, about the number of rows of ``left``, what is shuffled is dealt by their count.
    """
    if few:
        return left.join(F.broadcast(right), key)
    return left.join(shuffled(right), key) if rows is None else dealt(left, rows, *key).join(shuffled(dealt(right, rows, *key)), key)
