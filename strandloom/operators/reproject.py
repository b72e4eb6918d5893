"""Moving a contact map's cells from one layout to another without its contacts, for layouts of the same blocks.

Both layouts cut the map into pieces on which the way from the old to the new place is a shift or a mirror. A bin goes where its
middle goes, so that a map whose blocks begin and end at bins is moved exactly, and others nearly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.intervals import covering
from strandloom.functions.sizes import small_once
from strandloom.operators.layout import same_blocks


def piecewise(before: DataFrame, after: DataFrame) -> DataFrame:
    """old_start, old_end, mirrored and new_start of each block; both layouts have visual coordinates."""
    old = before.select("block_id", F.col("visual_start").alias("old_start"), F.col("visual_end").alias("old_end"), F.col("orientation").alias("_was"))
    new = after.select("block_id", F.col("visual_start").alias("new_start"), F.col("orientation").alias("_is"))
    return old.join(new, "block_id").select("old_start", "old_end", ((F.col("_was") == "-") != (F.col("_is") == "-")).alias("mirrored"), "new_start")


def moved_bins(bins: DataFrame, before: DataFrame, after: DataFrame, resolution: int, width: int = 1_000_000) -> DataFrame:
    """bin and the bin that its middle comes to; bins whose middle lies in a gap are left out."""
    middle = bins.select("bin", (F.col("bin") * resolution + resolution // 2).alias("at"))
    met = covering(middle, [], "at", piecewise(before, after), "old_start", "old_end", width)
    to = F.when(F.col("mirrored"), F.col("new_start") + F.col("old_end") - F.col("at") - 1).otherwise(F.col("new_start") + F.col("at") - F.col("old_start"))
    return met.select("bin", F.floor(to / resolution).cast("long").alias("to"))


def reproject(cells: DataFrame, before: DataFrame, after: DataFrame, resolution: int) -> DataFrame:
    """x_bin <= y_bin and count of the cells in the new layout; ValueError unless both have the same blocks of the same sources."""
    if not same_blocks(before, after).first()["permutation"]:
        raise ValueError("the layouts don't hold the same blocks")
    bins = cells.select(F.col("x_bin").alias("bin")).union(cells.select("y_bin")).distinct()
    moved = small_once(moved_bins(bins, before, after, resolution), "moved")
    side = lambda p: moved.select(F.col("bin").alias(f"{p}_bin"), F.col("to").alias(f"_{p}"))
    met = cells.join(side("x"), "x_bin").join(side("y"), "y_bin")
    return met.groupBy(F.least("_x", "_y").alias("x_bin"), F.greatest("_x", "_y").alias("y_bin")).agg(F.sum("count").alias("count"))
