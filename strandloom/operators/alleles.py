"""Alleles by contacts along lines: pairs of blocks or objects whose contacts lie on a diagonal or an anti-diagonal.

Everything is a sum by pair and window. A pair has some fifty windows on its shorter side, so that the expected weight of a
line, a convolution of its two margins, joins two short histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.sizes import small_once
from strandloom.functions.storage import materialise

#: Windows on the shorter side, and how many of them make a block large enough.
WINDOWS, LEAST_WINDOWS = 50, 5
#: Least concordance (exclusive), support, cells, covered windows and their share, and of a line: weight, enrichment, z, reciprocal coverage, effective share, reciprocal span.
PAIR_LEAST = {"concordance": 0.2, "support": 20.0, "cells": 3, "covered": 3, "covered_share": 0.1, "weight": 5.0, "enrichment": 1.5, "z": 3.0, "coverage": 0.1, "effective": 0.0, "span": 0.1}
#: What a line must have for high confidence, besides its weight and enrichment.
HIGH = {"z": 4.0, "coverage": 0.2, "effective": 0.1, "span": 0.2}
#: Of lines of objects: support, enrichment, excess, covered share, share of windows on a line and of its effective ones; windows of padding.
OBJECT_LEAST = {"support": 100.0, "enrichment": 1.3, "excess": 0.02, "coverage": 0.75, "span": 0.75, "effective": 0.4}
PADDING = 1
_PAIR = ["left", "right"]


def block_members(layout: DataFrame, resolution: int, least: int = LEAST_WINDOWS) -> DataFrame:
    """bin, id, source_id, object_id, length, weight (share of the bin) and at (middle, in the source's direction) of blocks of enough bins."""
    sized = layout.withColumn("length", F.col("visual_end") - F.col("visual_start")).filter((F.col("length") >= resolution * least) & (F.col("source_end") > F.col("source_start")))
    cut = sized.withColumn("bin", F.explode(F.expr(f"sequence(visual_start div {resolution}, (visual_end - 1) div {resolution})")))
    start, end = F.greatest("visual_start", F.col("bin") * resolution), F.least("visual_end", (F.col("bin") + 1) * resolution)
    shown = (start + end) / 2 - F.col("visual_start")
    at = F.when(F.col("orientation") == "-", F.col("length") - shown).otherwise(shown)
    return cut.select("bin", F.col("block_id").alias("id"), "source_id", "object_id", "length", ((end - start) / resolution).alias("weight"), at.alias("at"))


def _sides(cells: DataFrame, members: DataFrame, names: list[str]) -> DataFrame:
    """Positive cells with what stands in their two bins, x_ and y_."""
    held = small_once(members, "members")
    side = lambda p: held.select(F.col("bin").alias(f"{p}_bin"), *[F.col(c).alias(f"{p}_{c}") for c in names])
    return cells.filter((F.col("count") > 0) & (F.col("count") < float("inf"))).join(side("x"), "x_bin").join(side("y"), "y_bin")


def pair_cells(cells: DataFrame, members: DataFrame, resolution: int, windows: int = WINDOWS) -> DataFrame:
    """A row for each cell of a pair left < right of blocks of two sources: weight, windows and the modes of its lines.

    Windows are ``width`` bases; n_left and n_right of them cover the blocks, ``resolved`` the shorter. A mode is the distance (+) or the
    sum (-) of the two places in windows.
    """
    names = ["id", "source_id", "object_id", "length", "weight", "at"]
    met = _sides(cells, members, names).filter("x_id <> y_id AND x_source_id <> y_source_id AND (x_bin <> y_bin OR x_id < y_id)")
    first = F.col("x_id") < F.col("y_id")
    pick = lambda c, yes: F.when(first if yes else ~first, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}"))
    told = met.select(
        pick("id", True).alias("left"), pick("id", False).alias("right"), pick("object_id", True).alias("left_object"), pick("object_id", False).alias("right_object"), pick("length", True).alias("_ll"), pick("length", False).alias("_rl"),
        pick("at", True).alias("_la"), pick("at", False).alias("_ra"), (F.col("count") * F.col("x_weight") * F.col("y_weight")).alias("weight"),
    )
    shorter = F.least("_ll", "_rl")
    sized = told.withColumn("resolved", F.greatest(F.lit(1), F.least(F.lit(windows), F.floor(shorter / resolution))).cast("long")).withColumn("width", F.greatest(F.lit(1), F.floor(shorter / F.col("resolved"))).cast("long"))
    n = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.col("width"))).cast("long")
    at = lambda c, most: F.least(F.greatest(F.floor(F.col(c) / F.col("width")), F.lit(0)), F.col(most) - 1).cast("long")
    counted = sized.withColumn("n_left", n("_ll")).withColumn("n_right", n("_rl"))
    shorter_at = F.when(F.col("_ll") <= F.col("_rl"), F.col("_la")).otherwise(F.col("_ra"))
    return counted.select(
        *_PAIR, "left_object", "right_object", "n_left", "n_right", "resolved", "weight", at("_la", "n_left").alias("l"), at("_ra", "n_right").alias("r"),
        F.floor((F.col("_ra") - F.col("_la")) / F.col("width")).alias("plus"), F.floor((F.col("_ra") + F.col("_la")) / F.col("width")).alias("minus"), F.least(F.floor(shorter_at / F.col("width")), F.col("resolved") - 1).alias("s"),
    )


def _lines(plus: Column, minus: Column) -> Column:
    return F.explode(F.array(F.struct(F.lit("+").alias("line"), plus.alias("mode")), F.struct(F.lit("-").alias("line"), minus.alias("mode")))).alias("m")


def _summed(df: DataFrame, key: list[str], value: str = "weight") -> DataFrame:
    return df.groupBy(*_PAIR, *key).agg(F.sum(value).alias(value))


def line_bands(cells: DataFrame, radius: int = 1, digits: int = 9) -> DataFrame:
    """Each pair's line of the greatest z: left, right, line, mode, observed, expected, ratio, enrichment and z.

    A line is a band of modes. Its expected weight comes from the margins, as though places on the two sides were drawn by
    themselves: the sum of products of margins along the band over the pair's support. z and enrichment divide by an expectation
    of 1 at least. Ties go to enrichment, ratio, + and the lowest mode, after rounding; a pair without a line that is above its
    expectation has none.
    """
    support = cells.groupBy(*_PAIR).agg(F.sum("weight").alias("support"), F.max("n_left").alias("n_left"), F.max("n_right").alias("n_right"))
    margin = lambda c: _summed(cells, [c]).withColumnRenamed("weight", f"_{c}")
    products = margin("l").join(margin("r"), _PAIR).select(*_PAIR, (F.col("_l") * F.col("_r")).alias("product"), _lines(F.col("r") - F.col("l"), F.col("r") + F.col("l"))).select(*_PAIR, "m.*", "product", F.lit(0.0).alias("weight"))
    seen = cells.select(*_PAIR, _lines(F.col("plus"), F.col("minus")), "weight").select(*_PAIR, "m.*", F.lit(0.0).alias("product"), "weight")
    spread = products.unionByName(seen).groupBy(*_PAIR, "line", "mode").agg(F.sum("product").alias("product"), F.sum("weight").alias("weight"))
    banded = spread.withColumn("mode", F.explode(F.sequence(F.col("mode") - radius, F.col("mode") + radius))).groupBy(*_PAIR, "line", "mode").agg(F.sum("product").alias("product"), F.sum("weight").alias("observed"))
    plus = F.col("line") == "+"
    fits = (F.col("mode") >= F.when(plus, 1 - F.col("n_left")).otherwise(0)) & (F.col("mode") <= F.when(plus, F.col("n_right") - 1).otherwise(F.col("n_left") + F.col("n_right") - 2))
    rated = banded.join(support, _PAIR).filter(fits).withColumn("expected", F.col("product") / F.col("support"))
    floor = F.greatest("expected", F.lit(1.0))
    rated = rated.withColumn("ratio", F.round(F.col("observed") / F.col("support"), digits)).withColumn("enrichment", F.round(F.col("observed") / floor, digits)).withColumn("z", F.round((F.col("observed") - F.col("expected")) / F.sqrt(floor), digits))
    order = Window.partitionBy(*_PAIR).orderBy(F.desc("z"), F.desc("enrichment"), F.desc("ratio"), "line", "mode")
    best = rated.filter("z > 0 OR (z = 0 AND enrichment > 0)").withColumn("_k", F.row_number().over(order)).filter("_k = 1")
    return best.select(*_PAIR, "line", "mode", "observed", F.round("expected", digits).alias("expected"), "ratio", "enrichment", "z")


def line_spread(cells: DataFrame, lines: DataFrame, radius: int = 1) -> DataFrame:
    """left, right and of the cells within a pair's band: reciprocal coverage, effective share and reciprocal span.

    Each is the lesser of the two sides' values: windows that the band touches, (sum of weights)^2 / sum of squared weights of
    windows, and from the first to the last window, over all windows of the side.
    """
    met = cells.join(lines.select(*_PAIR, "line", "mode"), _PAIR)
    own = F.when(F.col("line") == "+", F.col("r") - F.col("l")).otherwise(F.col("r") + F.col("l"))
    near = met.filter(F.abs(own - F.col("mode")) <= radius)

    def side(at: str, n: str) -> DataFrame:
        each = near.groupBy(*_PAIR, n, at).agg(F.sum("weight").alias("weight"))
        w = F.sum("weight")
        return each.groupBy(*_PAIR, n).agg((F.count(F.lit(1)) / F.col(n)).alias(f"c_{at}"), (w * w / F.sum(F.col("weight") * F.col("weight")) / F.col(n)).alias(f"e_{at}"), ((F.max(at) - F.min(at) + 1) / F.col(n)).alias(f"s_{at}")).drop(n)

    both = side("l", "n_left").join(side("r", "n_right"), _PAIR)
    return both.select(*_PAIR, F.least("c_l", "c_r").alias("coverage"), F.least("e_l", "e_r").alias("effective"), F.least("s_l", "s_r").alias("span"))


def allele_pairs(cells: DataFrame, layout: DataFrame, resolution: int, least: dict | None = None, high: dict | None = None, windows: int = WINDOWS, across_objects: bool = False, line: str | None = None) -> DataFrame:
    """Pairs of blocks that contacts show as alleles, with model, line of the pair and tier.

    A pair needs support, cells and covered windows of its shorter side, and either concordance, the share of its heaviest mode
    of either direction, or a significant line. The tier is ``high`` where the line is significant by the stricter thresholds, else
    ``supported``. ``line`` asks for one direction, ``across_objects`` for two objects. Layouts have visual coordinates; an empty
    map gives no pairs.
    """
    least, high = PAIR_LEAST | (least or {}), HIGH | (high or {})
    met = materialise(pair_cells(cells, block_members(layout, resolution), resolution, windows), "pair_cells")
    whole = met.groupBy(*_PAIR, "left_object", "right_object", "resolved").agg(F.sum("weight").alias("support"), F.count(F.lit(1)).alias("cells"), F.countDistinct("s").alias("covered"))
    heaviest = lambda mode, name: _summed(met, [mode]).groupBy(*_PAIR).agg(F.max("weight").alias(name))
    lines = materialise(line_bands(met), "lines")
    told = whole.join(heaviest("plus", "_plus"), _PAIR).join(heaviest("minus", "_minus"), _PAIR).join(lines, _PAIR, "left").join(line_spread(met, lines), _PAIR, "left")
    zero = ["observed", "expected", "ratio", "enrichment", "z", "coverage", "effective", "span"]
    told = told.fillna(0.0, zero).withColumn("parallel", F.col("_plus") / F.col("support")).withColumn("antiparallel", F.col("_minus") / F.col("support")).withColumn("concordance", F.greatest("parallel", "antiparallel"))
    common = (F.col("support") >= least["support"]) & (F.col("cells") >= least["cells"]) & (F.col("covered") >= F.greatest(F.lit(least["covered"]), F.ceil(F.col("resolved") * least["covered_share"])))
    direction = F.when(F.col("parallel") >= F.col("antiparallel"), "+").otherwise("-")
    wanted = lambda c: F.lit(True) if line is None else F.coalesce(c == line, F.lit(False))
    concordant = (F.col("concordance") > least["concordance"]) & wanted(direction)
    heavy = (F.col("observed") >= least["weight"]) & (F.col("enrichment") >= least["enrichment"]) & wanted(F.col("line"))
    over = lambda x: (F.col("z") >= x["z"]) & (F.col("coverage") >= x["coverage"]) & (F.col("effective") >= x["effective"]) & (F.col("span") >= x["span"])
    kept = told.filter(common & (concordant | (heavy & over(least))) & (F.lit(not across_objects) | (F.col("left_object") != F.col("right_object"))))
    return kept.select(
        *_PAIR, "support", "cells", "resolved", "covered", "concordance", F.when(concordant, direction).otherwise(F.col("line")).alias("direction"), F.when(concordant, "concordance").otherwise("trans-line").alias("model"),
        "line", "mode", *zero, F.when(heavy & over(high), "high").otherwise("supported").alias("tier"),
    )


def object_spans(layout: DataFrame) -> DataFrame:
    """object_id, start and end of each object on the map."""
    return layout.filter("visual_end > visual_start AND source_end > source_start").groupBy("object_id").agg(F.min("visual_start").alias("start"), F.max("visual_end").alias("end"))


def object_lines(cells: DataFrame, layout: DataFrame, resolution: int, least: dict | None = None, windows: int = WINDOWS) -> DataFrame:
    """Lines between two objects left < right: line, mode, windows, support, ratio, expected, enrichment, excess, effective.

    Places are shares of an object's length in windows. A line is one mode; it must be long enough to span, and carried by enough
    effective cells. Of these the one of the greatest excess over its share of all cells, times the root of its effective cells,
    counts, ties to excess, enrichment, + and the lowest mode.
    """
    least = OBJECT_LEAST | (least or {})
    spans = object_spans(layout)
    cut = spans.withColumn("length", F.col("end") - F.col("start")).withColumn("bin", F.explode(F.expr(f"sequence(start div {resolution}, (`end` - 1) div {resolution})")))
    a, b = F.greatest("start", F.col("bin") * resolution), F.least("end", (F.col("bin") + 1) * resolution)
    members = cut.select("bin", F.col("object_id").alias("id"), "length", ((b - a) / resolution).alias("weight"), (((a + b) / 2 - F.col("start")) / F.col("length")).alias("at"))
    met = _sides(cells, members, ["id", "length", "weight", "at"]).filter("x_id <> y_id")
    first = F.col("x_id") < F.col("y_id")
    pick = lambda c, yes: F.when(first if yes else ~first, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}"))
    n = F.least(F.lit(windows), F.floor(F.least("x_length", "y_length") / resolution)).cast("long")
    told = met.select(pick("id", True).alias("left"), pick("id", False).alias("right"), n.alias("n"), pick("at", True).alias("_la"), pick("at", False).alias("_ra"), (F.col("count") * F.col("x_weight") * F.col("y_weight")).alias("weight")).filter(F.col("n") >= LEAST_WINDOWS)
    at = lambda c: F.least(F.floor(F.col(c) * F.col("n")), F.col("n") - 1).cast("long")
    grid = materialise(told.select(*_PAIR, "n", at("_la").alias("l"), at("_ra").alias("r"), "weight").groupBy(*_PAIR, "n", "l", "r").agg(F.sum("weight").alias("weight")), "object_cells")
    whole = grid.groupBy(*_PAIR, "n").agg(F.sum("weight").alias("support"), F.countDistinct("l").alias("_cl"), F.countDistinct("r").alias("_cr"))
    w = F.sum("weight")
    modes = grid.select(*_PAIR, "weight", _lines(F.col("r") - F.col("l"), F.col("r") + F.col("l"))).select(*_PAIR, "m.*", "weight").groupBy(*_PAIR, "line", "mode").agg(w.alias("weight"), (w * w / F.sum(F.col("weight") * F.col("weight"))).alias("effective"))
    chances = F.col("n") - F.abs(F.when(F.col("line") == "+", F.col("mode")).otherwise(F.col("mode") - (F.col("n") - 1)))
    rated = modes.join(whole, _PAIR).withColumn("_chances", chances).filter((F.col("_chances") >= F.ceil(F.col("n") * least["span"])) & (F.col("effective") >= F.greatest(F.lit(3.0), F.col("_chances") * least["effective"])))
    rated = rated.withColumn("ratio", F.col("weight") / F.col("support")).withColumn("expected", F.col("_chances") / (F.col("n") * F.col("n"))).withColumn("excess", F.col("ratio") - F.col("expected")).withColumn("enrichment", F.col("ratio") / F.col("expected"))
    order = Window.partitionBy(*_PAIR).orderBy(F.round(F.col("excess") * F.sqrt("effective"), 9).desc(), F.round("excess", 9).desc(), F.round("enrichment", 9).desc(), "line", "mode")
    best = rated.withColumn("_k", F.row_number().over(order)).filter("_k = 1")
    needed = F.ceil(F.col("n") * least["coverage"])
    kept = best.filter((F.col("support") >= least["support"]) & (F.col("_cl") >= needed) & (F.col("_cr") >= needed) & (F.col("enrichment") >= least["enrichment"]) & (F.col("excess") >= least["excess"]))
    return kept.select(*_PAIR, "line", "mode", F.col("n").alias("windows"), "support", "ratio", "expected", "enrichment", "excess", "effective")


def line_partners(lines: DataFrame, layout: DataFrame, selected: DataFrame, padding: float = PADDING) -> DataFrame:
    """block, partner, left, right, overlap and distance: blocks of the other object where a line brings a selected block.

    The selected block's windows are moved along the line, widened by ``padding`` windows, and meet the other object's blocks in
    cells of one window, so that no block is held against all others.
    """
    spans = object_spans(layout).select("object_id", F.col("start").alias("_s"), (F.col("end") - F.col("start")).alias("_length"))
    blocks = layout.filter("visual_end > visual_start AND source_end > source_start").select("block_id", "object_id", "visual_start", "visual_end").join(spans, "object_id")
    ways = lines.select("left", "right", "line", "mode", "windows", F.explode(F.array(F.struct(F.col("left").alias("here"), F.col("right").alias("there"), F.lit(1).alias("sign")), F.struct(F.col("right").alias("here"), F.col("left").alias("there"), F.lit(-1).alias("sign")))).alias("w")).select("left", "right", "line", "mode", "windows", "w.*")
    placed = lambda side: ways.join(blocks.withColumnRenamed("object_id", side), side).withColumn("from", (F.col("visual_start") - F.col("_s")) / F.col("_length") * F.col("windows")).withColumn("to", (F.col("visual_end") - F.col("_s")) / F.col("_length") * F.col("windows"))
    own = placed("here").join(selected.select(F.col("block_id")).distinct(), "block_id", "left_semi")
    plus, shift = F.col("line") == "+", F.col("sign") * F.col("mode")
    moved = own.select("left", "right", "there", F.col("block_id").alias("block"), (F.when(plus, F.col("from") + shift).otherwise(F.col("mode") - F.col("to")) - padding).alias("from"), (F.when(plus, F.col("to") + shift).otherwise(F.col("mode") - F.col("from")) + padding).alias("to"))
    spread = lambda df: df.withColumn("_cell", F.explode(F.sequence(F.floor("from"), F.floor("to"))))
    others = spread(placed("there").select("left", "right", "there", F.col("block_id").alias("partner"), F.col("from").alias("_from"), F.col("to").alias("_to"), "from", "to")).drop("from", "to")
    met = spread(moved).join(others, ["left", "right", "there", "_cell"]).withColumn("_at", F.greatest("from", "_from")).filter(F.floor("_at") == F.col("_cell"))
    overlap = F.least("to", "_to") - F.col("_at")
    return met.select("block", "partner", "left", "right", overlap.alias("overlap"), F.abs((F.col("_from") + F.col("_to")) / 2 - (F.col("from") + F.col("to")) / 2).alias("distance")).filter("overlap > 0")
