"""Statistics with the definitions that contact maps use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.running import total_before


def legacy_percentile(df: DataFrame, value: str, percents: list[float]) -> DataFrame:
    """percent and value by the (n + 1) rule: position p (n + 1) / 100 among the sorted values, interpolated.

    The values are counted by size first, so the sort holds distinct values, and positions meet them by a join.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = total_before(counts, "v", "n", "before").withColumn("hi", F.col("before") + F.col("n")).withColumn("lo", F.col("before") + 1)
    total = counts.agg(F.sum("n").alias("total"))
    spark = df.sparkSession
    asked = spark.createDataFrame([(float(p),) for p in percents], "percent double").crossJoin(F.broadcast(total)).filter("total > 0")  # one row for each percent
    pos = F.col("percent") * (F.col("total") + 1) / 100
    placed = asked.withColumn("pos", F.least(F.greatest(pos, F.lit(1.0)), F.col("total").cast("double"))).withColumn("k", F.floor("pos")).withColumn("k2", F.least(F.col("k") + 1, F.col("total")))
    at = lambda k, name: upto.select(F.col("lo").alias(f"lo_{name}"), F.col("hi").alias(f"hi_{name}"), F.col("v").alias(name))
    hit = F.broadcast(placed).join(at("k", "a"), (F.col("k") >= F.col("lo_a")) & (F.col("k") <= F.col("hi_a"))).join(at("k2", "b"), (F.col("k2") >= F.col("lo_b")) & (F.col("k2") <= F.col("hi_b")))
    return hit.select("percent", (F.col("a") + (F.col("pos") - F.col("k")) * (F.col("b") - F.col("a"))).alias("value"))


def median_and_mad(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Median, and median of the absolute distances from it, by key."""
    mid = df.groupBy(*key).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    away = df.join(mid, key).groupBy(*key, "median").agg(F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))
    return away


def coordinate_hash(x: Column, y: Column) -> Column:
    """32-bit hash of a cell that doesn't depend on the order of its coordinates."""
    mask = F.lit(4294967295).cast("long")
    left = (F.least(x, y) * F.lit(73856093).cast("long")).bitwiseAND(mask)
    right = (F.greatest(x, y) * F.lit(19349663).cast("long")).bitwiseAND(mask)
    return left.bitwiseXOR(right)


def colour_sample(cells: DataFrame, most: int = 10_000) -> DataFrame:
    """Off-diagonal positive cells; a tenth of them by their hash where there are more than ``most``."""
    shown = cells.filter("x_bin <> y_bin AND count > 0")
    many = shown.agg((F.count(F.lit(1)) > most).alias("many"))
    return shown.crossJoin(F.broadcast(many)).filter(~F.col("many") | (coordinate_hash(F.col("x_bin"), F.col("y_bin")) % 10 == 0)).drop("many")  # one row


def intensity(value: Column, low: float, high: float, log: bool = False) -> Column:
    """0 to 1 between low and high, by value or by log10(value + 1); a step where both are equal."""
    f = (lambda x: F.log10(x + 1)) if log else (lambda x: x)
    a, b = F.lit(low).cast("double"), F.lit(high).cast("double")
    if low == high:
        return F.when(value >= low, 1.0).otherwise(0.0)
    return F.least(F.greatest((f(value) - f(a)) / (f(b) - f(a)), F.lit(0.0)), F.lit(1.0))
