"""Blocks joined along links of an assembly graph: overlaps are trimmed, the trims are kept in a ledger, and can be undone.

A layout may carry ``assembly_block``, the joined unit of a block. The ledger has a row for each trimmed block: block_id,
line_no and overlap of the last link, trimmed bases in all, and the source interval before the first trim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.layout import COLUMNS

LEDGER = "block_id long, line_no long, overlap string, trimmed long, original_start long, original_end long"
#: Gap between blocks that are parted again.
DEFAULT_GAP = 100


def exact_overlap(cigar: Column) -> Column:
    """Bases of an overlap of matches alone, such as 12M or 5M3=; null for anything else."""
    parts = F.regexp_extract_all(cigar, F.lit("([0-9]+)[M=]"), F.lit(1))
    total = F.aggregate(F.transform(parts, lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(cigar.rlike("^([0-9]+[M=])+$"), total)


def _shown_side(orientation: str, displayed: str) -> Column:
    """The source end (start or end) that a block shows on its left or right."""
    back = F.col(orientation) == "-"
    return F.when(back, "end" if displayed == "left" else "start").otherwise("start" if displayed == "left" else "end")


def boundary_joins(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """pairs of neighbours with the link that joins them, the bases to trim from the right one, and why not, or null.

    ``pairs`` has left_id, right_id, and of each side (left_, right_) source, orientation, start and end; ``links`` line_no,
    from_segment, from_side, to_segment, to_side, overlap and verified. A link joins the ends that meet, read either way. Of
    two that do, one in each direction and both verified, the one that starts at the right block counts; other choices are
    ambiguous. Without any link between the two sources nothing is trimmed; with links at other ends only, it is a conflict.
    """
    reach = lambda a, b, forward: links.select(F.col(f"{a}_segment").alias("left_source"), F.col(f"{a}_side").alias("_ls"), F.col(f"{b}_segment").alias("right_source"), F.col(f"{b}_side").alias("_rs"), "line_no", "overlap", "verified", F.lit(forward).alias("_forward"))
    # a link of a source with itself that joins equal ends would be met from both sides
    both = reach("from", "to", True).unionByName(reach("to", "from", False).filter("left_source <> right_source OR _ls <> _rs"))
    met = pairs.join(both, ["left_source", "right_source"], "left")
    fits = F.coalesce((F.col("_ls") == _shown_side("left_orientation", "right")) & (F.col("_rs") == _shown_side("right_orientation", "left")), F.lit(False))
    of = lambda c: F.min(F.when(fits & c, F.struct("line_no", "overlap")))
    told = met.groupBy(*pairs.columns).agg(
        F.count("line_no").alias("_between"), F.count_if(fits).alias("_fit"), F.count_if(fits & F.col("_forward")).alias("_ahead"), F.count_if(fits & F.col("verified")).alias("_sure"), of(F.lit(True)).alias("_any"), of(~F.col("_forward")).alias("_back")
    )
    mutual = (F.col("_fit") == 2) & (F.col("_ahead") == 1) & (F.col("_sure") == 2)
    link = F.when(F.col("_fit") == 1, F.col("_any")).when(mutual, F.col("_back"))
    judged = told.withColumn("_link", link).withColumn("line_no", F.col("_link.line_no")).withColumn("overlap", F.col("_link.overlap"))
    judged = judged.withColumn("trim", F.when(F.col("line_no").isNull(), 0).otherwise(exact_overlap(F.col("overlap"))).cast("long"))
    unknown = ~F.col("left_orientation").isin("+", "-") | ~F.col("right_orientation").isin("+", "-")
    why = (
        F.when((F.col("_fit") > 1) & ~mutual, "several-overlaps").when((F.col("_fit") == 0) & (F.col("_between") > 0), "orientation-conflict").when(F.col("trim").isNull(), "overlap-not-exact")
        .when((F.col("trim") > 0) & unknown, "orientation-unknown").when(F.col("trim") >= F.col("right_end") - F.col("right_start"), "overlap-too-long")
    )
    return judged.withColumn("reason", why).drop("_between", "_fit", "_ahead", "_sure", "_any", "_back", "_link")


def _neighbours(layout: DataFrame, selected: DataFrame) -> DataFrame:
    """Pairs of neighbours in an object that are selected in one group."""
    w = Window.partitionBy("object_id").orderBy("ord")
    held = layout.join(selected.select("block_id", "group"), "block_id", "left")
    side = lambda c, name: F.lag(c).over(w).alias(name)
    before = [side("block_id", "left_id"), side("source_id", "left_source"), side("orientation", "left_orientation"), side("source_start", "left_start"), side("source_end", "left_end"), side("group", "_group")]
    joined = [side("assembly_block", "_unit"), F.col("assembly_block").alias("_own")] if "assembly_block" in layout.columns else [F.lit(None).cast("string").alias("_unit"), F.lit(None).cast("string").alias("_own")]
    told = held.select(*before, *joined, F.col("block_id").alias("right_id"), F.col("source_id").alias("right_source"), F.col("orientation").alias("right_orientation"), F.col("source_start").alias("right_start"), F.col("source_end").alias("right_end"), "gap_before", "group")
    return told.filter(F.col("group") == F.col("_group")).drop("_group")


def plan_blocks(layout: DataFrame, links: DataFrame, selected: DataFrame) -> DataFrame:
    """The joins of each group of neighbours (block_id, group): all of a group, or none of it if one fails.

    Columns of ``boundary_joins`` with group and ``done``. A group must be one run of neighbours of one object; one that isn't
    fails. Neighbours that are one unit already aren't joined again.
    """
    pairs = _neighbours(layout, selected).filter("_unit IS NULL OR _own IS NULL OR _unit <> _own")
    judged = boundary_joins(pairs.drop("_unit", "_own", "gap_before"), links)
    sizes = layout.join(selected, "block_id").groupBy("group").agg(F.count(F.lit(1)).alias("_blocks"))
    linked = _neighbours(layout, selected).groupBy("group").agg(F.count(F.lit(1)).alias("_pairs"))
    fails = judged.groupBy("group").agg(F.count("reason").alias("_fails"))
    whole = sizes.join(linked, "group").join(fails, "group", "left").select("group", ((F.col("_pairs") == F.col("_blocks") - 1) & (F.coalesce("_fails", F.lit(0)) == 0)).alias("done"))
    return judged.join(whole, "group")


def _apply(layout: DataFrame, joins: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    done = joins.filter("done").select(F.col("right_id").alias("block_id"), "line_no", "overlap", "trim")
    held = layout.join(done, "block_id", "left")
    trim, back = F.coalesce("trim", F.lit(0)), F.col("orientation") == "-"
    now = held.withColumn("_hit", F.col("trim").isNotNull()).withColumn("_s", F.when(back, F.col("source_start")).otherwise(F.col("source_start") + trim)).withColumn("_e", F.when(back, F.col("source_end") - trim).otherwise(F.col("source_end")))
    entry = now.filter("trim > 0").select("block_id", "line_no", "overlap", F.col("trim").alias("trimmed"), F.col("source_start").alias("original_start"), F.col("source_end").alias("original_end"))
    if ledger is not None:
        old = ledger.select("block_id", *[F.col(c).alias(f"_{c}") for c in ("line_no", "overlap", "trimmed", "original_start", "original_end")])
        met = entry.join(old, "block_id", "full_outer")
        entry = met.select("block_id", F.coalesce("line_no", "_line_no").alias("line_no"), F.coalesce("overlap", "_overlap").alias("overlap"), (F.coalesce("trimmed", F.lit(0)) + F.coalesce("_trimmed", F.lit(0))).alias("trimmed"), F.coalesce("_original_start", "original_start").alias("original_start"), F.coalesce("_original_end", "original_end").alias("original_end"))
    edited = now.withColumn("source_start", F.col("_s")).withColumn("source_end", F.col("_e")).withColumn("gap_before", F.when(F.col("_hit"), 0).otherwise(F.col("gap_before")).cast("long"))
    return edited.select(*COLUMNS, *[c for c in layout.columns if c == "assembly_block"]), entry


def create_blocks(layout: DataFrame, links: DataFrame, selected: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The layout with assembly_block, and the ledger, after the groups that can be joined are: gaps go, overlaps are trimmed.

    Groups that fail stay as they are. Ids of groups become units; a selected block of an older unit takes the new one.
    """
    joins = plan_blocks(layout, links, selected)
    edited, entry = _apply(layout, joins, ledger)
    units = selected.join(joins.filter("done").select("group").distinct(), "group", "left_semi").select("block_id", F.col("group").cast("string").alias("_unit"))
    old = F.col("assembly_block") if "assembly_block" in edited.columns else F.lit(None).cast("string")
    return edited.join(units, "block_id", "left").withColumn("assembly_block", F.coalesce("_unit", old)).select(*COLUMNS, "assembly_block"), entry


def dissolve_blocks(layout: DataFrame, ledger: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The layout and the ledger after the units of the chosen blocks (block_id) are parted and their trims undone.

    Each block but a unit's first gets a default gap before it, and the source interval it had before its first trim.
    """
    units = layout.join(chosen.select("block_id").distinct(), "block_id", "left_semi").filter("assembly_block IS NOT NULL").select("assembly_block").distinct().withColumn("_gone", F.lit(True))
    held = layout.join(units, "assembly_block", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    first = F.row_number().over(Window.partitionBy("assembly_block").orderBy("ord")) == 1
    trims = ledger.select("block_id", "original_start", "original_end")
    back = held.withColumn("_first", first).join(trims, "block_id", "left")
    undone = F.col("_gone") & F.col("original_start").isNotNull()
    edited = (
        back.withColumn("source_start", F.when(undone, F.col("original_start")).otherwise(F.col("source_start")))
        .withColumn("source_end", F.when(undone, F.col("original_end")).otherwise(F.col("source_end")))
        .withColumn("gap_before", F.when(F.col("_gone") & ~F.col("_first"), DEFAULT_GAP).otherwise(F.col("gap_before")).cast("long"))
        .withColumn("assembly_block", F.when(~F.col("_gone"), F.col("assembly_block")))
    )
    left = ledger.join(held.filter("_gone").select("block_id"), "block_id", "left_anti")
    return edited.select(*COLUMNS, "assembly_block"), left


def delete_gaps(layout: DataFrame, links: DataFrame, selected: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The layout and the ledger after the gaps between neighbours of a group (block_id, group) are deleted, all of a group or none.

    Parts of one source that touch in their direction become one block again, with the first's id; others are joined as in
    ``create_blocks``. Neighbours without a gap stay as they are.
    """
    pairs = _neighbours(layout, selected).filter("gap_before > 0").drop("_unit", "_own", "gap_before")
    touch = F.when(F.col("right_orientation") == "-", F.col("right_end") == F.col("left_start")).otherwise(F.col("left_end") == F.col("right_start"))
    siblings = (F.col("left_source") == F.col("right_source")) & (F.col("left_orientation") == F.col("right_orientation")) & touch
    whole = pairs.filter(siblings).withColumn("line_no", F.lit(None).cast("long")).withColumn("overlap", F.lit(None).cast("string")).withColumn("trim", F.lit(0).cast("long")).withColumn("reason", F.lit(None).cast("string"))
    judged = whole.withColumn("_sibling", F.lit(True)).unionByName(boundary_joins(pairs.filter(~siblings), links).select(*whole.columns).withColumn("_sibling", F.lit(False)))
    joins = judged.withColumn("done", F.count("reason").over(Window.partitionBy("group")) == 0)
    edited, entry = _apply(layout.select(*COLUMNS), joins, ledger)
    inner = joins.filter("done AND _sibling").select(F.col("right_id").alias("block_id"), F.lit(1).alias("_joins"))
    w = Window.partitionBy("object_id").orderBy("ord")
    runs = edited.join(inner, "block_id", "left").withColumn("_run", F.sum(F.when(F.col("_joins") == 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f = F.min(F.struct("ord", "block_id", "gap_before")).alias("_f")
    merged = runs.groupBy("object_id", "_run", "source_id", "orientation").agg(f, F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end"))
    return merged.select("_f.block_id", "object_id", "source_id", "source_start", "source_end", "orientation", "_f.gap_before", "_f.ord").select(*COLUMNS), entry
