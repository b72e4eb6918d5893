"""Running totals over a whole table in one order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.storage import materialise


#: Rows that one window may hold.
WINDOW_ROWS = 100_000


def total_before(df: DataFrame, order: str, value: str, name: str, descending: bool = False, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before each one; the first has 0.

    Values of ``order`` should be distinct: rows that tie follow each other in any order. Rows are dealt by ranges of it and
    written with the number of their range, so that numbers stay when a task is repeated; a window sums each range, and one
    over the ranges' totals, a row for each shuffle partition, adds what stands before. An empty table stays empty. A table that
    is counted first and has at most ``window_rows`` rows is one window.
    """
    spark = df.sparkSession
    key = F.col(order).desc() if descending else F.col(order).asc()
    if df.limit(window_rows + 1).count() <= window_rows:
        return df.withColumn(name, F.coalesce(F.sum(value).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()), "running")
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_of_range"))
    base = totals.select("_range", F.coalesce(F.sum("_of_range").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before_range"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn(name, inner).join(F.broadcast(base), "_range").withColumn(name, F.col(name) + F.col("_before_range")).drop("_range", "_before_range")  # a row for each range
