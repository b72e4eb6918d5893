"""Edits that repair what they displace, names, groups of objects, versions of a layout, and checks of what is read.

Layouts are those of ``operators.layout``: objects are contiguous in ``ord``. A unit is a run of blocks of an object
without a gap between them, named by its first block; edits move units whole.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.layout import COLUMNS, _renumbered, reverse

DEFAULT_GAP = 100
FORMAT, VERSION = "layout-history", 1


def with_units(layout: DataFrame) -> DataFrame:
    """``unit``: the first block of the run of blocks without gaps that a block belongs to."""
    w = Window.partitionBy("object_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.row_number().over(Window.partitionBy("object_id").orderBy("ord")) == 1
    head = layout.withColumn("_head", F.when((F.col("gap_before") > 0) | fresh, F.col("block_id")))
    return head.withColumn("unit", F.last("_head", ignorenulls=True).over(w)).drop("_head")


def repaired(layout: DataFrame, gap: int = DEFAULT_GAP) -> DataFrame:
    """The layout with a gap before each unit but an object's first one.

    A gap before an object's first block goes; the first unit of the object that lacks a gap takes it over, others
    get the default. ``layout`` has the units from before the edit.
    """
    w = Window.partitionBy("object_id").orderBy("ord")
    first = F.row_number().over(w) == 1
    marked = layout.withColumn("_first", first).withColumn("_lead", F.first("gap_before").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    marked = marked.withColumn("_lacks", ~F.col("_first") & (F.lag("unit").over(w) != F.col("unit")) & (F.col("gap_before") <= 0))
    turn = F.sum(F.col("_lacks").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fresh = F.when(F.col("_first"), 0).when(F.col("_lacks"), F.when((turn == 1) & (F.col("_lead") > 0), F.col("_lead")).otherwise(gap)).otherwise(F.col("gap_before"))
    return marked.withColumn("gap_before", fresh.cast("long")).select(*COLUMNS)


def delete_repaired(layout: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the blocks of ``gone`` (block_id), gaps repaired, order kept."""
    return repaired(with_units(layout).join(gone, "block_id", "left_anti"))


def move_to_debris(layout: DataFrame, chosen: DataFrame, object_id: str = "debris") -> DataFrame:
    """The units of the chosen blocks at the end, in their order, in the object of debris; gaps repaired."""
    units = with_units(layout)
    moving = units.join(chosen.select("block_id"), "block_id", "left_semi").select("unit").distinct().withColumn("_moves", F.lit(1))
    marked = units.join(moving, "unit", "left").withColumn("_key", F.coalesce("_moves", F.lit(0)))
    placed = marked.withColumn("object_id", F.when(F.col("_key") == 1, object_id).otherwise(F.col("object_id")))
    order = _renumbered(placed, "_key", "ord").select("block_id", F.col("ord").alias("_ord"))
    return repaired(placed.join(order, "block_id").withColumn("ord", F.col("_ord")))


def apply_recommendation(layout: DataFrame, chosen: Column, target: int, behind: bool, turned: bool) -> DataFrame:
    """The chosen blocks before or behind the target block, in its object, reversed if asked for; gaps repaired.

    The target may not be one of them; an unknown target changes nothing but gaps.
    """
    units = with_units(reverse(layout, chosen) if turned else layout)
    into = layout.filter((F.col("block_id") == target) & ~chosen).select(F.col("object_id").alias("_object"), F.col("ord").alias("_at"))
    placed = units.join(F.broadcast(into), F.lit(True), "left")  # one row: the target
    moves = chosen & F.col("_at").isNotNull()
    placed = placed.withColumn("_key", F.when(moves, F.col("_at") * 2 + (1 if behind else -1)).otherwise(F.col("ord") * 2)).withColumn("object_id", F.when(moves, F.col("_object")).otherwise(F.col("object_id")))
    order = _renumbered(placed, "_key", "ord").select("block_id", F.col("ord").alias("_ord"))
    return repaired(placed.join(order, "block_id").withColumn("ord", F.col("_ord")))


def rename_errors(layout: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (object_id, name) with name trimmed and ``error``: why the object can't take the name, else null."""
    known = layout.select(F.col("object_id").alias("name")).distinct().withColumn("_taken", F.lit(1))
    asked = requests.withColumn("name", F.trim("name")).join(known, "name", "left")
    error = (
        F.when(F.coalesce("name", F.lit("")) == "", "empty").when(F.col("name").rlike("\\s"), "white space").when(F.col("name") == F.col("object_id"), F.lit(None).cast("string")).when(F.col("_taken").isNotNull(), "taken")
    )
    return asked.select("object_id", "name", error.alias("error"))


def rename_objects(layout: DataFrame, requests: DataFrame) -> DataFrame:
    """Objects under the names that they may take; others keep theirs."""
    good = rename_errors(layout, requests).filter("error IS NULL").select("object_id", F.col("name").alias("_name")).dropDuplicates(["object_id"])
    return layout.join(good, "object_id", "left").withColumn("object_id", F.coalesce("_name", "object_id")).select(*layout.columns)


def blocks_between(layout: DataFrame, anchor: int, target: int) -> DataFrame:
    """Blocks from the anchor to the target, both included, whichever comes first; the target alone without an anchor."""
    ends = layout.filter(F.col("block_id").isin(anchor, target)).agg(F.min("ord").alias("_low"), F.max("ord").alias("_high"), F.max((F.col("block_id") == target).cast("int")).alias("_there"))
    return layout.join(F.broadcast(ends), (F.col("ord") >= F.col("_low")) & (F.col("ord") <= F.col("_high")) & (F.col("_there") == 1), "left_semi")


def chromosome_groups(layout: DataFrame, chosen: Column) -> DataFrame:
    """Span, units and lengths of each object, and those of its units that hold a chosen block; ``layout`` has visual coordinates."""
    units = with_units(layout).groupBy("object_id", "unit").agg(F.min("visual_start").alias("s"), F.max("visual_end").alias("e"), F.max(chosen.cast("int")).alias("c"))
    length = F.col("e") - F.col("s")
    return units.groupBy("object_id").agg(
        F.min("s").alias("visual_start"), F.max("e").alias("visual_end"), F.count(F.lit(1)).alias("total_count"), F.sum("c").cast("long").alias("selected_count"), F.sum(length).alias("total_length"), F.sum(length * F.col("c")).alias("selected_length")
    )


def gap_ranges(layout: DataFrame) -> DataFrame:
    """Where the gaps inside objects stand: object_id, block_id behind the gap, visual start and end."""
    inner = F.row_number().over(Window.partitionBy("object_id").orderBy("ord")) > 1
    return layout.withColumn("_inner", inner).filter("_inner AND gap_before > 0").select("object_id", "block_id", (F.col("visual_start") - F.col("gap_before")).alias("gap_start"), F.col("visual_start").alias("gap_end"))


@dataclass(frozen=True)
class History:
    """Versions of a layout: all snapshots in one table by version, the one that is shown, and the last one."""

    snapshots: DataFrame
    shown: int
    last: int

    @classmethod
    def of(cls, layout: DataFrame) -> History:
        return cls(layout.select(F.lit(0).alias("version"), *COLUMNS), 0, 0)

    def do(self, layout: DataFrame) -> History:
        """A version behind the one that is shown; those that were undone are gone."""
        at = self.shown + 1
        kept = self.snapshots.filter(F.col("version") < at)
        return History(kept.unionByName(layout.select(F.lit(at).alias("version"), *COLUMNS)), at, at)

    def undo(self, steps: int = 1) -> History:
        return replace(self, shown=max(0, self.shown - steps))

    def redo(self, steps: int = 1) -> History:
        return replace(self, shown=min(self.last, self.shown + steps))

    def undo_to(self, version: int) -> History:
        return replace(self, shown=min(max(0, version), self.shown))

    @property
    def layout(self) -> DataFrame:
        return self.snapshots.filter(F.col("version") == self.shown).select(*COLUMNS)


_ARCHIVE = "format string, version int, canonical string, shown int, block struct<version: int, block_id: long, object_id: string, source_id: string, source_start: long, source_end: long, orientation: string, gap_before: long, ord: long>"


def history_lines(history: History, canonical: str) -> DataFrame:
    """The history as JSON, a line for each block of each version; ``canonical`` names the layout that it belongs to."""
    rows = history.snapshots.select(*[F.col(c).cast("string") if c in ("object_id", "source_id") else F.col(c) for c in ["version", *COLUMNS]])
    head = [F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(canonical).alias("canonical"), F.lit(history.shown).alias("shown")]
    return rows.select(F.to_json(F.struct(*head, F.struct(*rows.columns).alias("block"))).alias("value"))


def read_history(lines: DataFrame, canonical: str) -> History:
    """The history of such lines. ValueError if one is damaged, of another format or version, or belongs to another layout."""
    rows = lines.select(F.from_json("value", _ARCHIVE).alias("r")).select("r.*")
    good = (F.col("format") == FORMAT) & (F.col("version") == VERSION) & (F.col("canonical") == canonical) & F.col("block.block_id").isNotNull() & F.col("block.version").isNotNull()
    state = rows.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"), F.count(F.lit(1)).alias("n"), F.min("shown").alias("a"), F.max("shown").alias("b"), F.max("block.version").alias("last")).first()
    if not state["n"] or state["bad"] or state["a"] != state["b"] or not 0 <= state["a"] <= state["last"]:
        raise ValueError("no history of this layout")
    return History(rows.select("block.*"), state["a"], state["last"])


def normalised_layout(rows: DataFrame) -> DataFrame:
    """Imported rows with defaults: the object is the id up to a colon, a missing start is 0, orientation + and gap 0."""
    return rows.select(
        "block_id", F.coalesce(F.nullif(F.col("object_id"), F.lit("")), F.split_part(F.col("id"), F.lit(":"), F.lit(1))).alias("object_id"), F.coalesce("source_id", F.col("id")).alias("source_id"),
        F.coalesce("source_start", F.lit(0).cast("long")).alias("source_start"), "source_end", F.when(F.col("orientation") == "-", "-").otherwise("+").alias("orientation"), F.greatest(F.coalesce("gap_before", F.lit(0).cast("long")), F.lit(0).cast("long")).alias("gap_before"),
    )


def chrom_offsets(bins: DataFrame) -> DataFrame:
    """chrom_id, first bin, bins, and whether the bins of the chromosome are one run: ids without holes and starts in their order.

    Bins need not be sorted; nothing is compared but counts and ends, so no window holds them all.
    """
    w = Window.partitionBy("chrom_id").orderBy("bin_id")
    marked = bins.withColumn("_falls", F.coalesce(F.lag("start").over(w) >= F.col("start"), F.lit(False)))
    return marked.groupBy("chrom_id").agg(F.min("bin_id").alias("first_bin"), F.count(F.lit(1)).alias("bins"), ((F.max("bin_id") - F.min("bin_id") + 1 == F.count(F.lit(1))) & ~F.max("_falls")).alias("ordered"))


def pixel_problems(pixels: DataFrame, n_bins: int) -> DataFrame:
    """Pixels that no matrix may hold: problem and how many there are. None of them means an empty table."""
    bad = F.array_compact(F.array(
        F.when(F.col("bin1_id").isNull() | F.col("bin2_id").isNull() | F.col("count").isNull(), "null"), F.when((F.col("bin1_id") < 0) | (F.col("bin2_id") < 0) | (F.col("bin1_id") >= n_bins) | (F.col("bin2_id") >= n_bins), "outside"),
        F.when(F.col("bin1_id") > F.col("bin2_id"), "lower triangle"), F.when(F.col("count") <= 0, "not positive"),
    ))
    twice = pixels.groupBy("bin1_id", "bin2_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated").alias("problem"))
    return pixels.select(F.explode(bad).alias("problem")).union(twice).groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


def homologs(names: DataFrame, pattern: str = "(Chr\\d+)g(\\d+)") -> DataFrame:
    """name, column and member of scaffolds by a pattern of two groups; both null for others and for ``Unplaced``."""
    found = (F.col("name") != "Unplaced") & (F.regexp_extract("name", pattern, 1) != "") & (F.regexp_extract("name", pattern, 2) != "")
    return names.select("name", *[F.when(found, F.regexp_extract("name", pattern, k)).alias(c) for k, c in ((1, "column"), (2, "member"))])


def link_scope(links: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """``links`` (from_scaffold, to_scaffold, ...) with ``scope``: within-scaffold, homolog or non-homolog."""
    one = scaffolds.select(F.col("name").alias("from_scaffold"), F.col("column").alias("_a"))
    two = scaffolds.select(F.col("name").alias("to_scaffold"), F.col("column").alias("_b"))
    scope = F.when(F.col("from_scaffold") == F.col("to_scaffold"), "within-scaffold").when(F.col("_a") == F.col("_b"), "homolog").otherwise("non-homolog")
    return links.join(one, "from_scaffold", "left").join(two, "to_scaffold", "left").withColumn("scope", scope).select(*links.columns, "scope")


def limit_graph(nodes: DataFrame, edges: DataFrame, most: int, required: Column) -> tuple[DataFrame, DataFrame]:
    """At most ``most`` nodes (node, ord), the required ones first and always, then by ord; and the edges (a, b) among them."""
    always = nodes.filter(required)
    left = max(0, most - always.count())  # one number
    kept = always.unionByName(nodes.filter(~F.coalesce(required, F.lit(False))).orderBy("ord", "node").limit(left))
    return kept, edges.join(kept.select(F.col("node").alias("a")), "a", "left_semi").join(kept.select(F.col("node").alias("b")), "b", "left_semi").select(*edges.columns)


def overlapping_closed(queries: DataFrame, ranges: DataFrame, width: int = 1_000_000) -> DataFrame:
    """query and block_id where both closed ranges share a point; ends that touch do. They meet in cells of ``width``."""
    cells = lambda s, e: F.explode(F.expr(f"sequence({s} div {width}, {e} div {width})")).alias("_cell")
    low, high = F.least("start", "end").alias("q_start"), F.greatest("start", "end").alias("q_end")
    asked = queries.select("query", low, high).select("*", cells("q_start", "q_end"))
    held = ranges.select("block_id", "visual_start", "visual_end", cells("visual_start", "visual_end"))
    hit = asked.join(held, "_cell").filter((F.col("visual_start") <= F.col("q_end")) & (F.col("visual_end") >= F.col("q_start")))
    first = F.expr(f"greatest(q_start, visual_start) div {width}")  # a pair counts in the first cell that it shares
    return hit.filter(first == F.col("_cell")).select("query", "block_id")


def by_precedence(*layers: DataFrame) -> DataFrame:
    """Rows (a, b, mask) of several layers, of each pair that of the last layer which has it."""
    rows = layers[0].withColumn("_layer", F.lit(0))
    for k, layer in enumerate(layers[1:], 1):
        rows = rows.unionByName(layer.withColumn("_layer", F.lit(k)))
    return rows.groupBy("a", "b").agg(F.max(F.struct("_layer", "mask")).alias("m")).select("a", "b", "m.mask")


def mask_difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: pairs (a, b) that only one, only the other, and both tables have."""
    both = one.select("a", "b").distinct().withColumn("x", F.lit(1)).join(other.select("a", "b").distinct().withColumn("y", F.lit(1)), ["a", "b"], "full")
    return both.agg(F.count_if(F.col("y").isNull()).alias("only_one"), F.count_if(F.col("x").isNull()).alias("only_other"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"))


def sibling_levels(pixels: DataFrame, factors: list[int]) -> DataFrame:
    """Sums of pixels at several coarser levels from one scan: factor, bin1_id, bin2_id and count."""
    rows = pixels.select(F.explode(F.array(*map(F.lit, factors))).alias("factor"), "bin1_id", "bin2_id", "count")
    return rows.groupBy("factor", F.expr("bin1_id div factor").alias("bin1_id"), F.expr("bin2_id div factor").alias("bin2_id")).agg(F.sum("count").alias("count"))


def positive_means(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Arithmetic and geometric mean of the positive finite values of each key; null where there are none."""
    good = F.when((F.col(value) > 0) & ~F.isnan(F.col(value).cast("double")) & (F.col(value).cast("double") < float("inf")), F.col(value).cast("double"))
    return rows.groupBy(key).agg(F.avg(good).alias("mean"), F.exp(F.avg(F.ln(good))).alias("geometric"))


def anchor_coordinate(side: Column, strand: Column, start: Column, end: Column) -> Column:
    """Reference coordinate of a segment's physical side: its start lies at the target's start on the forward strand."""
    return F.when((side == "start") == (strand == "+"), start).otherwise(end)
