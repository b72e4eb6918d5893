"""The layout: an ordered list of placed source intervals, and edits of it.

A layout has block_id, object_id, source_id, source_start, source_end, orientation,
gap_before and ord; visual coordinates follow from the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ["block_id", "object_id", "source_id", "source_start", "source_end", "orientation", "gap_before", "ord"]


def with_visual(layout: DataFrame) -> DataFrame:
    """visual_start and visual_end: running sums of gaps and lengths in the order, by object first, then over objects.

    Objects are numbered by their first block. The sum over objects has one row for each object; within an object
    the window is its own partition.
    """
    length = F.col("source_end") - F.col("source_start")
    spans = layout.groupBy("object_id").agg(F.min("ord").alias("first"), F.sum(length + F.col("gap_before")).alias("span"))
    before = F.coalesce(F.sum("span").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = spans.select("object_id", before.cast("long").alias("_offset"))
    inner = Window.partitionBy("object_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = layout.withColumn("_end", F.sum(length + F.col("gap_before")).over(inner)).join(offsets, "object_id")
    return placed.select(*layout.columns, (F.col("_offset") + F.col("_end") - length).alias("visual_start"), (F.col("_offset") + F.col("_end")).alias("visual_end"))


def visual_position(at: Column, orientation: str = "orientation", source_start: str = "source_start", source_end: str = "source_end", visual_start: str = "visual_start") -> Column:
    """Where a source position stands; a reversed block mirrors it, less one as positions are points."""
    forward = F.col(visual_start) + at - F.col(source_start)
    return F.when(F.col(orientation) == "-", F.col(visual_start) + F.col(source_end) - at - 1).otherwise(forward)


def visual_interval(start: Column, end: Column) -> tuple[Column, Column]:
    """Where a half-open source interval stands; mirrored without the one that points need."""
    back = F.col("orientation") == "-"
    return (
        F.when(back, F.col("visual_start") + F.col("source_end") - end).otherwise(F.col("visual_start") + start - F.col("source_start")),
        F.when(back, F.col("visual_start") + F.col("source_end") - start).otherwise(F.col("visual_start") + end - F.col("source_start")),
    )


def flip(orientation: Column) -> Column:
    return F.when(orientation == "+", "-").when(orientation == "-", "+").otherwise(orientation)


def _renumbered(layout: DataFrame, *order: Column | str) -> DataFrame:
    """ord from 1 in the given order, counted by object so that no window holds all blocks but that over objects.

    The first of ``order`` must be constant or rising over objects in the new order.
    """
    ranked = layout.withColumn("_first", F.min(F.struct(*order)).over(Window.partitionBy("object_id")))
    counts = ranked.groupBy("object_id", "_first").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("object_id", "_base")
    numbered = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("object_id").orderBy(*order))).join(offsets, "object_id")
    return numbered.withColumn("ord", (F.col("_base") + F.col("_k")).cast("long")).select(*COLUMNS)


def move_object_first(layout: DataFrame, object_id: str) -> DataFrame:
    """The object's blocks before all others, in their order."""
    return _renumbered(layout, (F.col("object_id") != object_id).cast("int"), "ord")


def move_before(layout: DataFrame, block_ids: list, target: int) -> DataFrame:
    """The blocks before the target, in its object, in their order; gaps stay with the blocks."""
    into = layout.filter(F.col("block_id") == target).select(F.col("object_id").alias("_object"), F.col("ord").alias("_ord"))
    moved = layout.filter(F.col("block_id").isin(block_ids)).crossJoin(F.broadcast(into))  # one row: the target
    moved = moved.withColumn("object_id", F.col("_object")).withColumn("_key", F.col("_ord") * 2 - 1)
    rest = layout.filter(~F.col("block_id").isin(block_ids)).withColumn("_key", F.col("ord") * 2)
    return _renumbered(rest.unionByName(moved.drop("_object", "_ord")), "_key", "ord")


def reverse(layout: DataFrame, chosen: Column) -> DataFrame:
    """Reverses each run of selected neighbours within an object: order, orientation, and the gaps between them."""
    w = Window.partitionBy("object_id").orderBy("ord")
    marked = layout.withColumn("_in", chosen).withColumn("_new", F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("object_id", "_in", "_run")
    back = run.orderBy(F.col("ord").desc())
    ahead = run.orderBy("ord")
    first_gap = F.first("gap_before").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mirrored = marked.withColumn("_k", F.row_number().over(back) - 1).withColumn("_low", F.min("ord").over(run))
    gap = F.when(F.col("_k") == 0, first_gap).otherwise(F.lead("gap_before").over(ahead))  # the gap that lay behind it
    turned = mirrored.withColumn("_gap", gap)
    return turned.select(
        "block_id", "object_id", "source_id", "source_start", "source_end",
        F.when(F.col("_in"), flip(F.col("orientation"))).otherwise(F.col("orientation")).alias("orientation"),
        F.when(F.col("_in"), F.col("_gap")).otherwise(F.col("gap_before")).alias("gap_before"),
        F.when(F.col("_in"), F.col("_low") + F.col("_k")).otherwise(F.col("ord")).cast("long").alias("ord"),
    )


def split_at(layout: DataFrame, visual: Column, gap: int = 100) -> DataFrame:
    """Cuts the blocks that hold a visual position strictly inside; ``layout`` has visual coordinates.

    The left child comes first in visual order, so of a reversed block it has the later source part. Children get
    ids 2n and 2n + 1 of the block's n; the right one has a default gap before it. Other blocks get id 2n.
    """
    inside = (visual > F.col("visual_start")) & (visual < F.col("visual_end"))
    offset = visual - F.col("visual_start")
    back = F.col("orientation") == "-"
    cut = F.when(back, F.col("source_end") - offset).otherwise(F.col("source_start") + offset)
    left = F.struct(F.lit(0).alias("side"), F.when(back, cut).otherwise(F.col("source_start")).alias("s"), F.when(back, F.col("source_end")).otherwise(cut).alias("e"), F.col("gap_before").alias("gap"))
    right = F.struct(F.lit(1).alias("side"), F.when(back, F.col("source_start")).otherwise(cut).alias("s"), F.when(back, cut).otherwise(F.col("source_end")).alias("e"), F.lit(gap).cast("long").alias("gap"))
    whole = F.struct(F.lit(0).alias("side"), F.col("source_start").alias("s"), F.col("source_end").alias("e"), F.col("gap_before").alias("gap"))
    parts = layout.withColumn("_p", F.explode(F.when(inside, F.array(left, right)).otherwise(F.array(whole))))
    return parts.select((F.col("block_id") * 2 + F.col("_p.side")).alias("block_id"), "object_id", "source_id", F.col("_p.s").alias("source_start"), F.col("_p.e").alias("source_end"), "orientation", F.col("_p.gap").alias("gap_before"), (F.col("ord") * 2 + F.col("_p.side")).alias("ord"))


def delete_blocks(layout: DataFrame, gone: DataFrame) -> DataFrame:
    return layout.join(gone, "block_id", "left_anti")


def copy_blocks(layout: DataFrame, chosen: DataFrame, object_id: str) -> DataFrame:
    """Adds further placements of the chosen blocks as an object at the end; the sources stay shared."""
    top = layout.agg(F.max("ord").alias("_top"), F.max("block_id").alias("_id"))
    copies = layout.join(chosen, "block_id", "left_semi").crossJoin(F.broadcast(top))  # one row: the last number
    copies = copies.withColumn("object_id", F.lit(object_id)).withColumn("ord", F.col("_top") + F.col("ord")).withColumn("block_id", F.col("_id") + F.col("block_id") + 1)
    return layout.select(*COLUMNS).unionByName(copies.select(*COLUMNS))


def split_copy_runs(layout: DataFrame) -> DataFrame:
    """copy_run: neighbours of one object, source and orientation that touch in source order are one placed copy."""
    w = Window.partitionBy("object_id").orderBy("ord")
    before = {c: F.lag(c).over(w) for c in ("source_id", "orientation", "source_start", "source_end")}
    touches = F.when(F.col("orientation") == "-", F.col("source_end") == before["source_start"]).otherwise(F.col("source_start") == before["source_end"])
    same = F.coalesce((before["source_id"] == F.col("source_id")) & (before["orientation"] == F.col("orientation")) & touches, F.lit(False))
    flagged = layout.withColumn("_new", (~same).cast("int"))
    return flagged.withColumn("copy_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def joined_runs(layout: DataFrame) -> DataFrame:
    """assembly_block_id: runs of blocks without a gap between them, numbered in their object where longer than one."""
    w = Window.partitionBy("object_id").orderBy("ord")
    run = F.sum((F.col("gap_before") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    sized = layout.withColumn("_run", run).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("object_id", "_run")))
    leads = (F.col("_size") > 1) & (F.row_number().over(Window.partitionBy("object_id", "_run").orderBy("ord")) == 1)
    numbered = sized.withColumn("_lead", leads.cast("int")).withColumn("_n", F.sum("_lead").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    name = F.when(F.col("_size") > 1, F.concat(F.col("object_id"), F.lit("_block_"), F.col("_n").cast("string")))
    return numbered.withColumn("assembly_block_id", name).drop("_run", "_size", "_lead", "_n")


def join_split_runs(layout: DataFrame) -> DataFrame:
    """Restores sources that were cut: neighbours of one copy run without a gap become one block, with the first's id and gap."""
    w = Window.partitionBy("object_id").orderBy("ord")
    runs = split_copy_runs(layout)
    apart = F.coalesce((F.lag("copy_run").over(w) != F.col("copy_run")) | (F.col("gap_before") > 0), F.lit(True))
    marked = runs.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("ord", "block_id", "gap_before")).alias("_f")
    merged = marked.groupBy("object_id", "_run", "source_id", "orientation").agg(first, F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end"))
    return merged.select("_f.block_id", "object_id", "source_id", "source_start", "source_end", "orientation", "_f.gap_before", "_f.ord").select(*COLUMNS)


def add_boundaries(layout: DataFrame, starts: Column) -> DataFrame:
    """Cuts objects before the blocks where ``starts`` holds; the parts behind the first are named object_d2, object_d3 and so on.

    The first block of a part loses its gap. A cut before an object's first block changes nothing.
    """
    w = Window.partitionBy("object_id").orderBy("ord")
    cut = F.coalesce(starts, F.lit(False)) & (F.row_number().over(w) > 1)
    marked = layout.withColumn("_cut", cut.cast("int")).withColumn("_part", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    name = F.when(F.col("_part") > 1, F.concat(F.col("object_id"), F.lit("_d"), F.col("_part").cast("string"))).otherwise(F.col("object_id"))
    return marked.withColumn("object_id", name).withColumn("gap_before", F.when(F.col("_cut") == 1, 0).otherwise(F.col("gap_before")).cast("long")).select(*COLUMNS)


def merge_objects(layout: DataFrame, pairs: DataFrame) -> DataFrame:
    """Objects that pairs (a, b) of ids join, directly or through others, take the smallest of their ids."""
    from strandloom.operators.graph import components

    into = components(pairs).withColumnRenamed("node", "object_id")
    return layout.join(into, "object_id", "left").withColumn("object_id", F.coalesce("component", "object_id")).select(*COLUMNS)


def place_segment(layout: DataFrame, source_id: Column, length: int, target: int, block_id: int, orientation: str = "+", gap: int = 100) -> DataFrame:
    """Puts an unplaced source before the target block, in its object, with default gaps on both sides."""
    at = layout.filter(F.col("block_id") == target).select(F.lit(block_id).cast("long").alias("block_id"), "object_id", source_id.alias("source_id"), F.lit(0).cast("long").alias("source_start"), F.lit(length).cast("long").alias("source_end"), F.lit(orientation).alias("orientation"), "gap_before", (F.col("ord") * 2 - 1).alias("_key"), "ord")
    rest = layout.withColumn("gap_before", F.when(F.col("block_id") == target, gap).otherwise(F.col("gap_before")).cast("long")).select(*COLUMNS, (F.col("ord") * 2).alias("_key"))
    return _renumbered(rest.unionByName(at), "_key", "ord")


def same_blocks(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row, ``permutation``: whether two layouts have the same ids with the same source intervals, in any order."""
    c = ["block_id", "source_id", "source_start", "source_end"]
    differs = one.select(*c).exceptAll(other.select(*c)).unionByName(other.select(*c).exceptAll(one.select(*c)))
    return differs.agg((F.count(F.lit(1)) == 0).alias("permutation"))


def nearest_boundary(layout: DataFrame, positions: DataFrame, width: int = 1_000_000, most: int = 1_000_000) -> DataFrame:
    """at, block_id and distance of the block whose visual start is nearest to each position, at most ``most`` away.

    Positions and starts meet in cells of ``width``; ties go to the smaller start, then the smaller id.
    """
    reach = -(-most // width)
    cells = positions.select("at", F.explode(F.expr(f"sequence(at div {width} - {reach}, at div {width} + {reach})")).alias("_cell"))
    starts = layout.select("block_id", "visual_start", F.expr(f"visual_start div {width}").alias("_cell"))
    away = F.abs(F.col("visual_start") - F.col("at"))
    hit = cells.join(starts, "_cell").withColumn("distance", away).filter(F.col("distance") <= most)
    return hit.groupBy("at").agg(F.min(F.struct("distance", "visual_start", "block_id")).alias("b")).select("at", "b.block_id", "b.distance")


def resolve_names(layout: DataFrame, sources: DataFrame) -> DataFrame:
    """block_id, resolved name and how: exact, coordinates (name:1-100), pieces (name_d2 that partition a source), or missing.

    ``sources`` has name and length; layout source ids are names. Pieces count only if all pieces of a base name, in
    the order of their number, add up to the source's length; a piece starts where the one before ends.
    """
    base = layout.select("block_id", F.col("source_id").alias("name"), (F.col("source_end") - F.col("source_start")).alias("len"))
    exact = base.join(sources.select("name", F.lit(1).alias("_hit")), "name", "left")
    ranged = exact.withColumn("_base", F.when(F.col("name").rlike("^.+:[0-9]+-[0-9]+$"), F.regexp_replace("name", ":[0-9]+-[0-9]+$", ""))).withColumn("_from", F.regexp_extract("name", ":([0-9]+)-[0-9]+$", 1).try_cast("long"))
    ranged = ranged.join(sources.select(F.col("name").alias("_base"), F.lit(1).alias("_ranged")), "_base", "left")
    pieces = ranged.withColumn("_root", F.regexp_replace("name", "_d[0-9]+$", "")).withColumn("_no", F.coalesce(F.regexp_extract("name", "_d([0-9]+)$", 1).try_cast("long"), F.lit(1).cast("long")))
    w = Window.partitionBy("_root")
    summed = pieces.withColumn("_total", F.sum("len").over(w)).withColumn("_start", F.coalesce(F.sum("len").over(w.orderBy("_no", "block_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = summed.join(sources.select(F.col("name").alias("_root"), F.col("length").alias("_whole")), "_root", "left")
    split = (F.col("_whole") == F.col("_total")) & (F.count(F.lit(1)).over(w) > 1)
    how = F.when(split, "pieces").when(F.col("_hit").isNotNull(), "exact").when(F.col("_ranged").isNotNull(), "coordinates").otherwise("missing")
    return joined.withColumn("how", how).select(
        "block_id", F.when(F.col("how") == "pieces", F.col("_root")).when(F.col("how") == "coordinates", F.col("_base")).when(F.col("how") == "exact", F.col("name")).alias("resolved"),
        F.when(F.col("how") == "pieces", F.col("_start")).when(F.col("how") == "coordinates", F.col("_from") - 1).when(F.col("how") == "exact", F.lit(0)).cast("long").alias("offset"), "how",
    )
