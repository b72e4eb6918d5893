"""Half-open intervals as DataFrames: islands, spans, overlaps, cuts and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.sizes import fits, meet


def merge_touching(df: DataFrame, key: list[str], start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """Unions of intervals that overlap, touch, or lie at most ``gap`` apart, by key; empty ones are dropped.

    Columns: the key, start, end and the number of ``members``.
    """
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    marked = df.filter(F.col(start) < F.col(end)).select(*key, start, end, fresh.alias("_fresh"))
    island = F.sum("_fresh").over(order.rangeBetween(Window.unboundedPreceding, 0))  # equal intervals, of which one may open an island, all count to it
    return marked.withColumn("_island", island).groupBy(*key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("members")).drop("_island")


def union_span(df: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Bases that the intervals of a key cover."""
    return merge_touching(df, key, start, end).groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("span"))


def intersection_span(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Bases that the unions of two sets of intervals share, by key; keys that share none are left out.

    A sweep over the ends of both unions, so that no pair of intervals is formed.
    """

    def ends(df: DataFrame, side: int) -> DataFrame:
        merged = merge_touching(df, key)
        step = lambda at, by: merged.select(*key, F.col(at).alias("at"), F.lit(by if side == 0 else 0).alias("l"), F.lit(by if side == 1 else 0).alias("r"))
        return step("start", 1).unionByName(step("end", -1))

    moves = ends(left, 0).unionByName(ends(right, 1)).groupBy(*key, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    order = Window.partitionBy(*key).orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = moves.select(*key, "at", F.lead("at").over(order).alias("next"), F.sum("l").over(run).alias("l"), F.sum("r").over(run).alias("r"))
    return swept.filter("l > 0 AND r > 0").groupBy(*key).agg(F.sum(F.col("next") - F.col("at")).alias("span"))


def elementary_segments(blocks: DataFrame, key: str, start: str, end: str, width: int = 1_000_000) -> DataFrame:
    """Each block cut at all starts and ends of its key's blocks, with ``copies``: the blocks that cover the piece.

    Columns of ``blocks`` stay; seg_start and seg_end are added. Blocks and pieces meet in cells of ``width``, a piece in that of its
    start, so that the pieces of a key aren't all held against all of its blocks; empty blocks have no piece.
    """
    cuts = blocks.select(F.col(key).alias("_key"), F.col(start).alias("seg_start")).union(blocks.select(key, end)).distinct()
    pieces = cuts.withColumn("seg_end", F.lead("seg_start").over(Window.partitionBy("_key").orderBy("seg_start"))).filter("seg_end IS NOT NULL")
    spread = blocks.filter(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.expr(f"sequence({start} div {width}, ({end} - 1) div {width})")))
    pieces = pieces.withColumn("_at", F.expr(f"seg_start div {width}"))
    placed = spread.join(pieces, (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_at")) & (F.col(start) <= F.col("seg_start")) & (F.col(end) >= F.col("seg_end")))
    return placed.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(key, "seg_start"))).drop("_key", "_cell", "_at")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Bases that two intervals share; negative where a gap parts them."""
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def covering(points: DataFrame, point_key: list[str], at: str, intervals: DataFrame, start: str, end: str, width: int, rows: int | None = None) -> DataFrame:
    """Intervals of a key that hold a point, by an equality join on cells of ``width`` so that a hot key is spread.

    Each interval is listed in the cells that it touches; a point stands in one. Rows: all columns of both. With ``rows``, about the
    number of points, the cells are counted and broadcast only if they are few, and else points and cells are dealt by ``rows``.
    """
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(f"({end} - 1) div {width}"))))
    placed, key = points.withColumn("_cell", F.expr(f"{at} div {width}")), [*point_key, "_cell"]
    met = placed.join(cells, key) if rows is None else meet(placed, cells, key, fits(cells), rows)
    return met.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")
