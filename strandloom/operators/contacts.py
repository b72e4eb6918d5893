"""Contacts projected through the layout into two-dimensional bins and tiles.

Contacts have source1, start1, source2, start2 and count. The layout is the small side:
it is cut into elementary segments that know how many placements cover them, so that one
join without a shuffle of the contacts gives a position and its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.intervals import covering, elementary_segments, overlap
from strandloom.functions.sizes import dealt, fits, meet, small
from strandloom.functions.storage import materialise
from strandloom.operators.layout import visual_position


def placements(layout: DataFrame) -> DataFrame:
    """Segments of the layout with copies; ``layout`` has visual coordinates."""
    return elementary_segments(layout.select("source_id", "source_start", "source_end", "orientation", "visual_start", "visual_end"), "source_id", "source_start", "source_end")


def projected(contacts: DataFrame, layout: DataFrame, cell: int = 1_000_000, rows: int | None = None) -> DataFrame:
    """x <= y and the share of the count for every pair of placements of a contact's two ends.

    Shares divide by all placements of either end, whether a viewport shows them or not. Ends and segments meet in cells of
    ``cell`` source bases, so that an end is not held against every piece of a long source. With ``rows``, about the number of
    contacts, contacts and segments of a large layout are dealt by it.
    """
    spread = placements(layout).withColumn("cell", F.explode(F.expr(f"sequence(seg_start div {cell}, (seg_end - 1) div {cell})")))
    segments = materialise(spread, "segments")
    few, hit = fits(segments), contacts
    for n in (1, 2):
        end = segments.select(*[F.col(c).alias(f"source{n}" if c == "source_id" else f"{c}_{n}") for c in segments.columns])
        inside = (F.col(f"start{n}") >= F.col(f"seg_start_{n}")) & (F.col(f"start{n}") < F.col(f"seg_end_{n}"))
        hit = meet(hit.withColumn(f"cell_{n}", F.expr(f"start{n} div {cell}")), end, [f"source{n}", f"cell_{n}"], few, rows).filter(inside)
    at = lambda n: visual_position(F.col(f"start{n}"), f"orientation_{n}", f"source_start_{n}", f"source_end_{n}", f"visual_start_{n}")
    return hit.select(F.least(at(1), at(2)).alias("x"), F.greatest(at(1), at(2)).alias("y"), (F.col("count") / (F.col("copies_1") * F.col("copies_2"))).alias("share"))


def in_viewport(viewport: tuple[int, int, int, int] | None, symmetric: bool = False) -> Column:
    """Positions in the half-open box x0, x1, y0, y1; a symmetric view also takes the mirrored position."""
    if viewport is None:
        return F.lit(True)
    x0, x1, y0, y1 = viewport
    box = lambda x, y: (F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1)
    return box("x", "y") | box("y", "x") if symmetric else box("x", "y")


def bin_sums(points: DataFrame, resolution: int, rows: int | None = None) -> DataFrame:
    """Cells x_bin, y_bin and count; a cell that only zeros fell into stays. With ``rows``, about the number of points, they are dealt by x_bin."""
    cells = points.select(F.expr(f"x div {resolution}").alias("x_bin"), F.expr(f"y div {resolution}").alias("y_bin"), "share")
    cells = cells if rows is None else dealt(cells, rows, "x_bin")
    return cells.groupBy("x_bin", "y_bin").agg(F.sum("share").alias("count"))


def project(contacts: DataFrame, layout: DataFrame, resolution: int, viewport: tuple[int, int, int, int] | None = None, symmetric: bool = False, rows: int | None = None) -> DataFrame:
    """The contact map of a layout at a resolution; for a large one at a fine resolution ``rows`` gives about the number of contacts, by which tasks are dealt."""
    if resolution <= 0 or viewport is not None and (viewport[0] >= viewport[1] or viewport[2] >= viewport[3]):
        raise ValueError("a resolution is positive and a viewport's starts lie before its ends")
    return bin_sums(projected(contacts, layout, rows=rows).filter(in_viewport(viewport, symmetric)), resolution, rows)


def tiles(cells: DataFrame, tile_bins: int) -> DataFrame:
    """tile_x, tile_y, cells (number) and total of each tile of tile_bins x tile_bins cells."""
    keyed = cells.withColumn("tile_x", F.expr(f"x_bin div {tile_bins}")).withColumn("tile_y", F.expr(f"y_bin div {tile_bins}"))
    return keyed.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("cells"), F.sum("count").alias("total"))


def requested_tiles(cells: DataFrame, wanted: DataFrame, tile_bins: int) -> DataFrame:
    """Cells of the wanted tiles (tile_x, tile_y), in any triangle."""
    keys = wanted.select(F.least("tile_x", "tile_y").alias("tile_x"), F.greatest("tile_x", "tile_y").alias("tile_y")).distinct()
    keyed = cells.withColumn("tile_x", F.expr(f"x_bin div {tile_bins}")).withColumn("tile_y", F.expr(f"y_bin div {tile_bins}"))
    return keyed.join(small(keys), ["tile_x", "tile_y"], "left_semi").drop("tile_x", "tile_y")


def viewport_ranges(layout: DataFrame, x0: int, x1: int) -> DataFrame:
    """Source intervals that a visual interval shows, to be pushed down to a scan; ``layout`` has visual coordinates."""
    lo, hi = F.greatest(F.col("visual_start"), F.lit(x0)), F.least(F.col("visual_end"), F.lit(x1))
    shown = layout.filter(overlap(F.col("visual_start"), F.col("visual_end"), F.lit(x0), F.lit(x1)) > 0)
    back = F.col("orientation") == "-"
    start = F.when(back, F.col("source_end") - (hi - F.col("visual_start"))).otherwise(F.col("source_start") + lo - F.col("visual_start"))
    return shown.select("source_id", start.alias("start"), (start + hi - lo).alias("end"))


def select_ranges(contacts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Contacts of which both starts lie in ranges (source_id, start, end), which must not overlap: two semi-joins."""
    held = small(ranges)
    for n in (1, 2):
        r = held.select(F.col("source_id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        contacts = contacts.join(r, (F.col(f"source{n}") == F.col("_id")) & (F.col(f"start{n}") >= F.col("_s")) & (F.col(f"start{n}") < F.col("_e")), "left_semi")
    return contacts


def window_pairs(contacts: DataFrame, windows: DataFrame, cell: int = 1_000_000, rows: int | None = None) -> DataFrame:
    """w1 <= w2 and count of the contacts between windows (source_id, window, start, end) of any lengths; others are left out.

    Windows of a source may overlap: a contact counts for each that holds its end. Ends meet windows in cells of ``cell`` bases. With ``rows``,
    about the number of contacts, cells are broadcast only if they are few, and tasks are dealt by ``rows``.
    """
    side = lambda n: windows.select(F.col("source_id").alias(f"source{n}"), F.col("window").alias(f"_w{n}"), F.col("start").alias(f"_s{n}"), F.col("end").alias(f"_e{n}")).filter(F.col(f"_s{n}") < F.col(f"_e{n}"))
    first = covering(contacts.select("source1", "start1", "source2", "start2", "count"), ["source1"], "start1", side(1), "_s1", "_e1", cell, rows)
    both = covering(first, ["source2"], "start2", side(2), "_s2", "_e2", cell, rows)
    pairs = both.select(F.least("_w1", "_w2").alias("w1"), F.greatest("_w1", "_w2").alias("w2"), "count")
    return (pairs if rows is None else dealt(pairs, rows, "w1", "w2")).groupBy("w1", "w2").agg(F.sum("count").alias("count"))
