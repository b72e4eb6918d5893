"""A multi-resolution matrix as Parquet tables: chroms, bins and pixels, the last two partitioned by resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sizes import small
from strandloom.operators import balance, curation, pyramid
from strandloom.sources.ranged import offset_problems

#: Weight columns of a level and whether they divide.
STORED = {"ICE": ("weight", False), "KR": ("KR", True), "VC": ("VC", True), "VC_SQRT": ("VC_SQRT", True)}


def generate(pixels: DataFrame, chroms: DataFrame, path: str, resolutions: list[int], base: int, methods: tuple[str, ...] = ("VC", "VC_SQRT"), kr_least: int = 0) -> None:
    """Writes all levels with the stored weights of ``methods``; bins without a weight hold NaN.

    Pixels that no matrix may hold are a ValueError, as are rows whose offsets don't fit what was written. Knight-Ruiz weights are
    made for levels of ``kr_least`` bases or more alone. ICE weights that haven't settled are stored as far as they came:
    ``states`` tells of each level and method whether they have, and how far the marginals are from their mean.
    """
    size = pyramid.bins(chroms, base).count()
    wrong = sorted(r["problem"] for r in curation.pixel_problems(pixels, size).collect())  # a row for each kind
    if wrong:
        raise ValueError(f"pixels that no matrix may hold: {', '.join(wrong)}")
    chroms.write.mode("overwrite").parquet(f"{path}/chroms")
    states: list[tuple[int, str, bool, float | None]] = []
    for resolution, level in pyramid.build_levels(pixels, chroms, resolutions, base).items():
        bins = pyramid.bins(chroms, resolution)
        out = bins.join(pyramid.row_offsets(level, bins), "bin_id")
        for method in methods:
            column, divisive = STORED[method]
            if method == "KR" and resolution < kr_least:
                out = out.withColumn(column, F.lit(float("nan")))
                continue
            settled, variance = True, None
            if method == "ICE":
                w, settled, variance = balance.ice_stored(level)
            else:
                w = balance.knight_ruiz(level) if method == "KR" else balance.vanilla(level, bins, method == "VC_SQRT")
            states.append((resolution, method, settled, variance))
            out = out.join(balance.stored_form(w, divisive).withColumnRenamed("stored", column), "bin_id", "left").withColumn(column, F.coalesce(column, F.lit(float("nan"))))
        level.write.mode("overwrite").parquet(f"{path}/pixels/resolution={resolution}")
        out.write.mode("overwrite").parquet(f"{path}/bins/resolution={resolution}")
        spark = pixels.sparkSession
        rows = spark.read.parquet(f"{path}/bins/resolution={resolution}").select("bin_id", "bin1_offset")
        n_bins, n_pixels = rows.count(), spark.read.parquet(f"{path}/pixels/resolution={resolution}").count()
        ends = rows.unionByName(spark.createDataFrame([(n_bins, n_pixels)], "bin_id long, bin1_offset long"))
        if not offset_problems(ends, n_bins, n_pixels).isEmpty():
            raise ValueError(f"the rows of level {resolution} don't fit its pixels")
    pixels.sparkSession.createDataFrame(states, "resolution long, method string, settled boolean, variance double").write.mode("overwrite").parquet(f"{path}/states")


def resolutions(spark: SparkSession, path: str) -> list[int]:
    """Levels, coarsest first."""
    return [r[0] for r in spark.read.parquet(f"{path}/bins").select("resolution").distinct().orderBy(F.desc("resolution")).collect()]  # one number a level


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """name and length of the sequences."""
    return spark.read.parquet(f"{path}/chroms").select(F.col("chrom_id").alias("name"), "length")


def inferred_resolution(bins: DataFrame, first: int = 1_024) -> int | None:
    """The longest of the first bins, which is the resolution of a table that doesn't name one; None for an empty table."""
    return bins.filter(F.col("bin_id") < first).agg(F.max(F.col("end") - F.col("start"))).first()[0]


def contacts(spark: SparkSession, path: str, resolution: int, method: str | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """source1, start1, source2, start2 and count of a level; with a method, balanced, and pixels without both weights go.

    ``ranges`` (source_id, start, end) keeps pixels of which both bins start in a range. The level is a partition, so
    others aren't read.
    """
    at = F.col("resolution") == resolution
    bins = spark.read.parquet(f"{path}/bins").filter(at).drop("resolution")
    if ranges is not None:
        r = small(ranges.select(F.col("source_id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e")))
        bins = bins.join(r, (F.col("chrom_id") == F.col("_id")) & (F.col("start") >= F.col("_s")) & (F.col("start") < F.col("_e")), "left_semi")
    weight = F.lit(1.0)
    if method:
        column, divisive = STORED[method]
        stored = F.col(column)
        fine = ~F.isnan(stored) & (stored > 0) & (stored < float("inf"))
        bins = bins.filter(fine)
        weight = 1.0 / stored if divisive else stored
    side = lambda n: bins.select(F.col("bin_id").alias(f"bin{n}_id"), F.col("chrom_id").alias(f"source{n}"), F.col("start").alias(f"start{n}"), weight.alias(f"_w{n}"))
    joined = spark.read.parquet(f"{path}/pixels").filter(at).join(small(side(1)), "bin1_id").join(small(side(2)), "bin2_id")
    return joined.select("source1", "start1", "source2", "start2", (F.col("count") * F.col("_w1") * F.col("_w2") if method else F.col("count")).alias("count"))
