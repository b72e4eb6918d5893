"""Structured Streaming forms: additive map deltas, event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.contacts import projected


def map_deltas(contacts: DataFrame, layout: DataFrame, resolution: int) -> DataFrame:
    """A streaming contact map, for update mode: each trigger gives the cells that changed, with their sums so far."""
    points = projected(contacts, layout)
    return points.groupBy(F.expr(f"x div {resolution}").alias("x_bin"), F.expr(f"y div {resolution}").alias("y_bin")).agg(F.sum("share").alias("count"))


def merge_batch(path: str):
    """A foreachBatch sink that keeps one folder for each batch, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def merged(spark, path: str, key: list[str], value: str) -> DataFrame:
    """The sum of all batches of additive deltas that merge_batch has kept."""
    return spark.read.parquet(path).groupBy(*key).agg(F.sum(value).alias(value))


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and totals by type and window; events later than the watermark are dropped in a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("bucket"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("user_id", "first_ts", "last_ts", "n")


def once_each(deltas: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Drops deltas that come again, by key, within the watermark of their ``ts``."""
    return deltas.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
