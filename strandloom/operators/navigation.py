"""Finding places on a map: typed coordinates, what a view shows and what stands beside it, links of a selection, thinned cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.running import total_before
from strandloom.functions.storage import materialise
from strandloom.operators.evidence import contact_links

#: Largest whole number that a typed coordinate may have; neighbours on either side of a block.
MOST_COORDINATE, FLANK = 2**53 - 1, 5
# Fixed values of the coordinate hash.
_SEED, _FIRST, _SECOND, _WORD = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35, 0xFFFFFFFF
_INTERVAL = "^(.+):([0-9,]+)-([0-9,]+)$"


def jumps(layout: DataFrame, asked: DataFrame) -> DataFrame:
    """id, block_id, visual_start, visual_end and problem of asked places (id, text): ``name`` or ``name:start-end``, commas allowed.

    A name is a block's source or its id; only where no name is equal, case is set aside. Problems: empty, form (a colon without an
    interval), number (not whole or too large), order (the end isn't behind the start), missing, ambiguous (several blocks), outside
    (not within the block's source interval). ``layout`` has visual coordinates; repeated rows of ``asked`` are answered once.
    """
    text = F.trim(F.col("text"))
    number = lambda k: F.regexp_replace(F.regexp_extract(text, _INTERVAL, k), ",", "").try_cast("long")
    ranged = text.rlike(_INTERVAL)
    name = F.when(ranged, F.trim(F.regexp_extract(text, _INTERVAL, 1))).otherwise(text)
    fine = lambda c: F.coalesce(F.col(c) <= MOST_COORDINATE, F.lit(False))
    read = asked.select("id", "text", name.alias("name"), ranged.alias("_ranged"), F.when(ranged, number(2)).alias("_from"), F.when(ranged, number(3)).alias("_to")).distinct()
    form = (
        F.when(F.coalesce(F.trim(F.col("text")), F.lit("")) == "", "empty").when(~F.col("_ranged") & F.col("text").contains(":"), "form").when(F.col("_ranged") & ((F.col("name") == "") | ~fine("_from") | ~fine("_to")), "number").when(F.col("_to") <= F.col("_from"), "order")
    )
    read = read.withColumn("problem", form)
    blocks = layout.select("block_id", "source_id", "source_start", "source_end", "orientation", "visual_start")
    names = lambda change: blocks.select("*", F.explode(F.array_distinct(F.array(change(F.col("source_id").cast("string")), change(F.col("block_id").cast("string"))))).alias("_name"))
    live = read.filter("problem IS NULL").drop("problem")
    exact = live.join(names(lambda c: c), F.col("name") == F.col("_name"))
    loose = live.join(exact.select("id", "text").distinct(), ["id", "text"], "left_anti").join(names(F.lower), F.lower(F.col("name")) == F.col("_name"))
    found = exact.unionByName(loose).groupBy("id", "text", "_from", "_to").agg(F.countDistinct("block_id").alias("_n"), F.min(F.struct("block_id", "source_start", "source_end", "orientation", "visual_start")).alias("b"))
    start, end = F.coalesce("_from", "b.source_start"), F.coalesce("_to", "b.source_end")
    outside = (start < F.col("b.source_start")) | (end > F.col("b.source_end"))
    at = F.when(F.col("b.orientation") == "-", F.col("b.visual_start") + F.col("b.source_end") - end).otherwise(F.col("b.visual_start") + start - F.col("b.source_start"))
    told = found.select("id", "text", F.when(F.col("_n") > 1, "ambiguous").when(outside, "outside").alias("_why"), F.col("b.block_id").alias("block_id"), at.alias("visual_start"), (at + end - start).alias("visual_end"))
    joined = read.join(told, ["id", "text"], "left").withColumn("problem", F.coalesce("problem", F.when(F.col("block_id").isNull(), "missing"), "_why"))
    shown = lambda c: F.when(F.col("problem").isNull(), F.col(c)).alias(c)
    return joined.select("id", shown("block_id"), shown("visual_start"), shown("visual_end"), "problem")


def view_objects(layout: DataFrame, viewport: tuple[int, int, int, int], columns: DataFrame | None = None) -> DataFrame:
    """object_id of objects that a view (x0, x1, y0, y1) shows on either axis; with ``columns`` (object_id, column), all of theirs."""
    x0, x1, y0, y1 = viewport
    shows = lambda a, b: (F.col("visual_end") > a) & (F.col("visual_start") < b)
    seen = layout.filter(shows(x0, x1) | shows(y0, y1)).select("object_id").distinct()
    return seen if columns is None else columns.join(columns.join(seen, "object_id", "left_semi").select("column").distinct(), "column", "left_semi").select("object_id").distinct()


def view_neighbours(layout: DataFrame, viewport: tuple[int, int, int, int], selected: DataFrame, flank: int = FLANK) -> DataFrame:
    """block_id of the blocks at most ``flank`` places from a selected one, or from the one in the middle of either axis, in its object.

    Where no block holds the middle, the one that shows most of the axis counts, of several the first.
    """
    x0, x1, y0, y1 = viewport

    def focus(start: int, end: int) -> DataFrame:
        middle = (F.col("visual_start") * 2 <= start + end) & (F.col("visual_end") * 2 > start + end)
        shown = F.least("visual_end", F.lit(end)) - F.greatest("visual_start", F.lit(start))
        return layout.filter(shown > 0).agg(F.max_by("block_id", F.struct(middle, F.when(middle, 0).otherwise(shown), -F.col("visual_start"))).alias("block_id"))

    focal = focus(x0, x1).unionByName(focus(y0, y1)).unionByName(selected.select("block_id")).filter("block_id IS NOT NULL").distinct()
    placed = layout.select("block_id", "object_id", F.row_number().over(Window.partitionBy("object_id").orderBy("visual_start", "visual_end", "block_id")).alias("_at"))
    near = placed.join(focal, "block_id", "left_semi").select("object_id", F.explode(F.sequence(F.col("_at") - flank, F.col("_at") + flank)).alias("_at")).distinct()
    return placed.join(near, ["object_id", "_at"], "left_semi").select("block_id")


def selected_links(cells: DataFrame, layout: DataFrame, resolution: int, selected: DataFrame) -> DataFrame:
    """As ``contact_links``, of pairs of a selected block (block_id) and one that isn't."""
    return contact_links(cells, layout, resolution, selected)


def cell_hash(x: Column, y: Column) -> Column:
    """32-bit hash of a cell's two coordinates, in this order."""
    low = lambda c: c.bitwiseAND(F.lit(_WORD))
    # a product of two 32-bit numbers may pass 63 bits: its low half is the sum of two that don't
    times = lambda a, by: low(low(a.bitwiseAND(F.lit(0xFFFF)) * F.lit(by)) + F.shiftleft(low(F.shiftright(a, 16) * F.lit(by)).bitwiseAND(F.lit(0xFFFF)), 16))
    first = times(low(x).bitwiseXOR(F.lit(_SEED)), _FIRST)
    both = first.bitwiseXOR(times(low(y.bitwiseXOR(F.shiftright(first, 16))), _SECOND))
    return both.bitwiseXOR(F.shiftright(both, 16))


def thinned(cells: DataFrame, most: int) -> DataFrame:
    """Cells whose hash lies below the share ``most`` of all cells, and of these the first ``most`` by place; all of a smaller map."""
    cells = materialise(cells, "cells")  # its size, the cells that are kept and theirs are asked for
    n = cells.count()
    if n <= most:
        return cells
    kept = cells.filter(cell_hash(F.col("x_bin"), F.col("y_bin")) < int(max(1, most) / n * 2**32)).withColumn("_place", F.struct("x_bin", "y_bin")).withColumn("_one", F.lit(1))
    return total_before(kept, "_place", "_one", "_before").filter(F.col("_before") < most).drop("_place", "_one", "_before")


def ambiguous_links(links: DataFrame, layout: DataFrame) -> DataFrame:
    """One row: links of placed sources, of which ``unique`` join two single placements and ``ambiguous`` don't, and ``unplaced`` others."""
    counts = layout.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    of = lambda p: counts.select(F.col("source_id").alias(f"{p}_segment"), F.col("_n").alias(f"_{p}"))
    both = links.join(of("from"), "from_segment", "left").join(of("to"), "to_segment", "left")
    placed, single = F.col("_from").isNotNull() & F.col("_to").isNotNull(), (F.col("_from") == 1) & (F.col("_to") == 1)
    return both.agg(F.count_if(single).alias("unique"), F.count_if(placed & ~single).alias("ambiguous"), F.count_if(~placed).alias("unplaced"))


def gap_bridges(links: DataFrame, layout: DataFrame) -> DataFrame:
    """line_no, left_id, right_id and gap of links that join the facing ends of neighbours with a gap between them.

    Both sources are placed once. ``links`` has line_no, from_segment, from_side, to_segment, to_side.
    """
    w = Window.partitionBy("object_id").orderBy("ord")
    once = layout.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("source_id")))
    side = lambda c, left: F.when(F.col(c) == "-", "start" if left else "end").otherwise("end" if left else "start")
    pairs = once.select(F.lag("block_id").over(w).alias("left_id"), F.lag("source_id").over(w).alias("_ls"), F.lag("orientation").over(w).alias("_lo"), F.lag("_n").over(w).alias("_ln"), F.col("block_id").alias("right_id"), F.col("source_id").alias("_rs"), F.col("orientation").alias("_ro"), "_n", F.col("gap_before").alias("gap"))
    facing = pairs.filter("gap > 0 AND _n = 1 AND _ln = 1 AND _lo IN ('+', '-') AND _ro IN ('+', '-')").select("left_id", "right_id", "gap", "_ls", "_rs", side("_lo", True).alias("_le"), side("_ro", False).alias("_re"))
    reach = lambda a, b: links.select("line_no", F.col(f"{a}_segment").alias("_ls"), F.col(f"{a}_side").alias("_le"), F.col(f"{b}_segment").alias("_rs"), F.col(f"{b}_side").alias("_re"))
    return facing.join(reach("from", "to").unionByName(reach("to", "from")), ["_ls", "_le", "_rs", "_re"]).select("line_no", "left_id", "right_id", "gap").distinct()
