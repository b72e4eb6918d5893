"""Coverage tracks projected through the layout: length-weighted means of bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sizes import small_once
from strandloom.operators.contacts import placements
from strandloom.operators.layout import visual_interval


def project_coverage(records: DataFrame, layout: DataFrame, resolution: int, x_start: int | None = None, x_end: int | None = None) -> DataFrame:
    """x_bin and value of records (chrom, start, end, value): each placement gets its share, each bin the mean over covered bases."""
    segments = small_once(placements(layout), "segments")
    hit = records.join(segments, (F.col("chrom") == F.col("source_id")) & (F.col("start") < F.col("seg_end")) & (F.col("end") > F.col("seg_start")))
    lo, hi = visual_interval(F.greatest("start", "seg_start"), F.least("end", "seg_end"))
    parts = hit.select(lo.alias("lo"), hi.alias("hi"), (F.col("value") / F.col("copies")).alias("share")).filter("lo < hi")
    bins = parts.withColumn("x_bin", F.explode(F.expr(f"sequence(lo div {resolution}, (hi - 1) div {resolution})")))
    if x_start is not None:
        bins = bins.filter((F.col("x_bin") >= x_start // resolution) & (F.col("x_bin") <= (x_end - 1) // resolution))
    length = F.expr(f"least(hi, (x_bin + 1) * {resolution}) - greatest(lo, x_bin * {resolution})")
    return bins.groupBy("x_bin").agg((F.sum(F.col("share") * length) / F.sum(length)).alias("value"))
