"""Evidence between placed sequences: contact links, allele edges, adjacency, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.intervals import overlap
from strandloom.functions.running import total_before
from strandloom.functions.sizes import dealt, fits, meet, shuffled, small_once
from strandloom.functions.storage import materialise

#: Bins on a side of the squares to which pairs of blocks are dealt.
TILE_BINS = 64


def bin_members(layout: DataFrame, resolution: int, *also: str) -> DataFrame:
    """bin, block_id, bases of the block in the bin, and its share of the bases that blocks cover there; ``also`` are further columns."""
    cells = layout.withColumn("bin", F.explode(F.expr(f"sequence(visual_start div {resolution}, (visual_end - 1) div {resolution})")))
    bases = cells.select("bin", "block_id", F.expr(f"least(visual_end, (bin + 1) * {resolution}) - greatest(visual_start, bin * {resolution})").alias("bases"), *also)
    return bases.withColumn("share", F.col("bases") / F.sum("bases").over(Window.partitionBy("bin")))


def contact_links(cells: DataFrame, layout: DataFrame, resolution: int, selected: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """source < target, raw_count and normalized_per_mb2 of blocks, from a map of the same resolution.

    A cell's count is dealt to its members' pairs by their shares; pairs of a block with itself are dropped. With ``selected``
    (block_id) only pairs of a selected block and one that isn't are formed. A map gives many times more pairs than it has cells, so cells
    are shuffled with their bins' members to squares of ``TILE_BINS`` bins, and pairs are formed and summed there: a pair belongs to the
    square in which its two blocks begin, and a cell goes to all squares that its members ask for. With ``rows``, about the number
    of cells, tasks are dealt by the pairs that so many cells give, about eight each.
    """
    sized = layout.withColumn("mb", (F.col("visual_end") - F.col("visual_start")) / 1e6).withColumn("home", F.expr(f"visual_start div {resolution} div {TILE_BINS}"))
    own = ["own"] if selected is not None else []
    if own:
        sized = sized.join(selected.select("block_id").distinct().withColumn("_in", F.lit(True)), "block_id", "left").withColumn("own", F.coalesce("_in", F.lit(False)))
    members = bin_members(sized, resolution, "mb", "home", *own)
    # the members of a bin that begin in one square, in one row
    homes = small_once(members.groupBy("bin", "home").agg(F.collect_list(F.struct("block_id", "share", "mb", *own)).alias("held")), "members")
    side = lambda n: homes.select(F.col("bin").alias(f"{n}_bin"), F.col("home").alias(f"h{n}"), F.col("held").alias(f"held_{n}"))
    met = cells.join(side("x"), "x_bin").join(side("y"), "y_bin")
    squares = met.select(F.least("hx", "hy").alias("_h1"), F.greatest("hx", "hy").alias("_h2"), "count", "held_x", "held_y")
    squares = squares.repartition("_h1", "_h2") if rows is None else dealt(squares, 8 * rows, "_h1", "_h2")
    opened = squares.withColumn("x", F.explode("held_x")).drop("held_x").withColumn("y", F.explode("held_y")).drop("held_y").filter("x.block_id <> y.block_id" + " AND x.own <> y.own" * len(own))
    summed = opened.groupBy("_h1", "_h2", F.least("x.block_id", "y.block_id").alias("source"), F.greatest("x.block_id", "y.block_id").alias("target")).agg(F.sum(F.col("count") * F.col("x.share") * F.col("y.share")).alias("raw_count"), F.max(F.col("x.mb") * F.col("y.mb")).alias("_mb2"))
    return summed.select("source", "target", "raw_count", (F.col("raw_count") / F.col("_mb2")).alias("normalized_per_mb2"))


def _ranked_ends(links: DataFrame, score: str) -> DataFrame:
    order = [F.col(score).desc(), "source", "target"]
    ends = links.select("*", F.col("source").alias("_end")).unionByName(links.select("*", F.col("target").alias("_end")))
    return ends.withColumn("_rank", F.row_number().over(Window.partitionBy("_end").orderBy(*order)))


def top_partners(links: DataFrame, k: int, score: str = "score", both: bool = False) -> DataFrame:
    """Links among the k best of either end, or with ``both`` of each of the two."""
    kept = _ranked_ends(links, score).filter(F.col("_rank") <= k).groupBy("source", "target", score).agg(F.count(F.lit(1)).alias("_n"))
    return kept.filter(F.col("_n") >= (2 if both else 1)).select("source", "target", score)


def rounds_by_rank(links: DataFrame, k: int, limit: int, score: str = "score") -> DataFrame:
    """The first links when every end in turn gives its best, then its second best, and so on to the k-th."""
    best = _ranked_ends(links, score).filter(F.col("_rank") <= k).groupBy("source", "target", score).agg(F.min("_rank").alias("round"))
    return best.orderBy("round", F.col(score).desc(), "source", "target").limit(limit)


def percentile_rank(links: DataFrame, score: str = "score") -> DataFrame:
    """evidence: 1 for the best link down to 0 for the last, ties by name; 1 for a single one.

    Ranks are counted within equal scores and over the distinct scores, so that no window holds all links unless
    all scores differ.
    """
    levels = links.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    placed = links.join(total_before(levels, score, "_n", "_before", descending=True).select(score, "_before"), score)
    at = F.col("_before") + F.row_number().over(Window.partitionBy(score).orderBy("source", "target")) - 1
    total = links.agg(F.count(F.lit(1)).alias("_total"))
    ranked = placed.withColumn("_at", at).crossJoin(F.broadcast(total))  # one row
    return ranked.select("source", "target", score, F.when(F.col("_total") <= 1, 1.0).otherwise(1 - F.col("_at") / (F.col("_total") - 1)).alias("evidence"))


def quadrants(cells: DataFrame, blocks: DataFrame, pairs: DataFrame, resolution: int, window: int) -> DataFrame:
    """source, target and contacts ll, lr, rl, rr between the end windows of two blocks (left and right of each)."""
    ends = blocks.select("block_id", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.col("visual_start").alias("s"), F.least(F.col("visual_start") + window, "visual_end").alias("e")),
        F.struct(F.lit("r").alias("side"), F.greatest(F.col("visual_end") - window, "visual_start").alias("s"), F.col("visual_end").alias("e")),
    )).alias("w")).select("block_id", "w.*")
    parts = ends.withColumn("bin", F.explode(F.expr(f"sequence(s div {resolution}, (e - 1) div {resolution})")))
    parts = parts.select("block_id", "side", "bin", (F.expr(f"least(e, (bin + 1) * {resolution}) - greatest(s, bin * {resolution})") / resolution).alias("part"))
    mirrored = cells.unionByName(cells.filter("x_bin <> y_bin").select(F.col("y_bin").alias("x_bin"), F.col("x_bin").alias("y_bin"), "count"))
    # a bin holds few windows, while a pair has many pairs of bins, most of them without a cell: so the map's cells meet windows, and what they give meets the pairs
    parts = shuffled(parts)
    a = parts.select(F.col("block_id").alias("source"), F.col("side").alias("sa"), F.col("bin").alias("x_bin"), F.col("part").alias("pa"))
    b = parts.select(F.col("block_id").alias("target"), F.col("side").alias("sb"), F.col("bin").alias("y_bin"), F.col("part").alias("pb"))
    hit = mirrored.join(a, "x_bin").join(b, "y_bin")
    value = F.col("count") * F.col("pa") * F.col("pb")
    one = lambda x, y: F.sum(F.when((F.col("sa") == x) & (F.col("sb") == y), value).otherwise(0.0)).alias(x + y)
    return shuffled(hit.groupBy("source", "target").agg(*[one(x, y) for x in "lr" for y in "lr"])).join(pairs.select("source", "target").distinct(), ["source", "target"])


def end_contacts(cells: DataFrame, blocks: DataFrame, resolution: int, window: int, rows: int) -> DataFrame:
    """source < target, ll, lr, rl and rr of cells between end windows of two blocks, to be summed by pair; as ``quadrants``.

    ``cells`` are of x_bin <= y_bin and dealt by x_bin, as ``contacts.project`` gives them with the same ``rows``. A bin's part of both
    windows is one row, and a cell gives a pair one row for all four contacts.
    """
    left, right = ("visual_start", f"least(visual_start + {window}, visual_end)"), (f"greatest(visual_end - {window}, visual_start)", "visual_end")
    bins = lambda s, e: f"sequence({s} div {resolution}, ({e} - 1) div {resolution})"
    part = lambda s, e: f"greatest(0, least({e}, (bin + 1) * {resolution}) - greatest({s}, bin * {resolution})) / {resolution}"
    cut = blocks.filter("visual_start < visual_end").select("block_id", "visual_start", "visual_end", F.explode(F.expr(f"array_union({bins(*left)}, {bins(*right)})")).alias("bin"))
    parts = cut.select("bin", "block_id", F.expr(part(*left)).alias("l"), F.expr(part(*right)).alias("r"))
    side = lambda n: shuffled(dealt(parts.select(F.col("bin").alias(f"{n}_bin"), F.col("block_id").alias(f"b{n}"), F.col("l").alias(f"l{n}"), F.col("r").alias(f"r{n}")), rows, f"{n}_bin"))
    met = dealt(cells.join(side("x"), "x_bin"), rows, "y_bin").join(side("y"), "y_bin").filter("bx <> by AND (x_bin <> y_bin OR bx < by)")
    first = F.col("bx") < F.col("by")
    value = lambda x, y: F.col("count") * F.col(x) * F.col(y)
    crossed = lambda one, two: F.when(first, one).otherwise(two)
    return met.select(F.least("bx", "by").alias("source"), F.greatest("bx", "by").alias("target"), value("lx", "ly").alias("ll"), crossed(value("lx", "ry"), value("rx", "ly")).alias("lr"), crossed(value("rx", "ly"), value("lx", "ry")).alias("rl"), value("rx", "ry").alias("rr"))


def line_modes(cells: DataFrame, members: DataFrame, width: int, rows: int | None = None) -> DataFrame:
    """Per pair of blocks, orientation and mode: contacts along a diagonal or an anti-diagonal of width bases.

    ``members`` has bin, block_id and at (a local coordinate). With ``rows``, about the number of cells, tasks are dealt by it, and
    all rows of a pair come to one, so that what is asked of a pair's modes needs no further shuffle.
    """
    members = materialise(members, "members")
    few = fits(members)
    x = members.select(F.col("bin").alias("x_bin"), F.col("block_id").alias("source"), F.col("at").alias("a"))
    y = members.select(F.col("bin").alias("y_bin"), F.col("block_id").alias("target"), F.col("at").alias("b"))
    hit = meet(meet(cells, x, ["x_bin"], few, rows), y, ["y_bin"], few, rows).filter("source < target")
    hit = hit if rows is None else dealt(hit, 2 * rows, "source", "target")  # each gives two modes
    modes = hit.select("source", "target", "count", F.explode(F.array(F.struct(F.lit("+").alias("line"), F.floor((F.col("b") - F.col("a")) / width).alias("mode")), F.struct(F.lit("-").alias("line"), F.floor((F.col("b") + F.col("a")) / width).alias("mode")))).alias("m"))
    return modes.groupBy("source", "target", "m.line", "m.mode").agg(F.sum("count").alias("weight"))


def strongest_line(modes: DataFrame) -> DataFrame:
    """The mode of greatest weight of each pair, ties to + and the lowest mode, and its share of the orientation's weight."""
    w = Window.partitionBy("source", "target").orderBy(F.col("weight").desc(), "line", "mode")
    total = F.sum("weight").over(Window.partitionBy("source", "target", "line"))
    return modes.withColumn("share", F.col("weight") / total).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def anchor_overlaps(anchors: DataFrame, cell: int) -> DataFrame:
    """a < b of one target whose intervals share bases: shared, reciprocal and shorter coverage, and what kind of edge.

    Pairs meet in the cell of ``cell`` bases where their overlap begins, so that a hot target is spread and each pair
    is found once.
    """
    spread = anchors.withColumn("_cell", F.explode(F.expr(f"sequence(start div {cell}, (end - 1) div {cell})")))
    side = lambda n: spread.select("target", "_cell", F.col("anchor").alias(n), F.col("start").alias(f"{n}s"), F.col("end").alias(f"{n}e"))
    pairs = side("a").join(side("b"), ["target", "_cell"]).filter(F.col("a") < F.col("b"))
    shared = overlap(F.col("as"), F.col("ae"), F.col("bs"), F.col("be"))
    once = F.col("_cell") == F.expr(f"greatest(as, bs) div {cell}")
    la, lb = F.col("ae") - F.col("as"), F.col("be") - F.col("bs")
    rated = pairs.withColumn("shared", shared).filter((F.col("shared") > 0) & once).withColumn("reciprocal", F.col("shared") / F.greatest(la, lb)).withColumn("shorter", F.col("shared") / F.least(la, lb))
    crossing = ((F.col("as") < F.col("bs")) & (F.col("ae") < F.col("be"))) | ((F.col("as") > F.col("bs")) & (F.col("ae") > F.col("be")))
    kind = F.when(F.col("reciprocal") >= 0.5, "allele").when((F.col("reciprocal") <= 0.1) & crossing, "boundary").otherwise("partial")
    return rated.select("target", "a", "b", "shared", "reciprocal", "shorter", kind.alias("kind"))


def nearest(anchors: DataFrame, k: int) -> DataFrame:
    """The k nearest anchors that end before, and begin behind, each anchor of the same target, by gap.

    With starts and ends in one order, the candidates behind an anchor are the k next starts, and before it the k
    last ends; a window over the target's events finds them without forming pairs.
    """
    base = anchors.select("target", "anchor", "start", "end")
    starts = base.select("target", F.col("start").alias("at"), F.lit(1).alias("kind"), "anchor", F.struct(F.col("start").alias("at"), "anchor").alias("s"), F.lit(None).cast("struct<at:bigint,anchor:bigint>").alias("e"))
    ends = base.select("target", F.col("end").alias("at"), F.lit(0).alias("kind"), "anchor", F.lit(None).cast("struct<at:bigint,anchor:bigint>").alias("s"), F.struct(F.col("end").alias("at"), "anchor").alias("e"))
    counts = starts.unionByName(ends)
    order = Window.partitionBy("target").orderBy("at", "kind", "anchor")
    # ordinal among starts and among ends of the target
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = counts.withColumn("n_s", F.sum("kind").over(seen)).withColumn("n_e", F.sum(1 - F.col("kind")).over(seen))
    s_list = numbered.filter("kind = 1").select("target", F.col("n_s").alias("n"), F.col("anchor").alias("other"), F.col("at").alias("other_at"))
    e_list = numbered.filter("kind = 0").select("target", F.col("n_e").alias("n"), F.col("anchor").alias("other"), F.col("at").alias("other_at"))
    behind = numbered.filter("kind = 0").select("target", "anchor", "at", F.explode(F.sequence(F.col("n_s") + 1, F.col("n_s") + k)).alias("n")).join(s_list, ["target", "n"])
    ahead = numbered.filter("kind = 1").select("target", "anchor", "at", F.explode(F.sequence(F.col("n_e"), F.greatest(F.col("n_e") - k + 1, F.lit(0)), F.lit(-1))).alias("n")).join(e_list, ["target", "n"])
    after = behind.select("target", "anchor", "other", F.lit("after").alias("side"), (F.col("other_at") - F.col("at")).alias("gap"))
    before = ahead.select("target", "anchor", "other", F.lit("before").alias("side"), (F.col("at") - F.col("other_at")).alias("gap"))
    return after.unionByName(before)


def dominance(scores: DataFrame) -> DataFrame:
    """Each query's best target, its score and its share of all the query's scores; ties to the smallest target."""
    total = F.sum("score").over(Window.partitionBy("query"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "target"))
    return scores.withColumn("dominance", F.col("score") / total).withColumn("_k", rank).filter("_k = 1").drop("_k")


def locus_stats(alignments: DataFrame) -> DataFrame:
    """Per query and target: base-weighted identity and mapq, strand dominance, aligned bases and score."""
    bp = F.col("query_end") - F.col("query_start")
    plus = F.sum(F.when(F.col("strand") == "+", bp).otherwise(0))
    out = alignments.groupBy("query_name", "target_name").agg(
        F.sum(bp).alias("bases"), (F.sum(F.col("matches")) / F.sum("block_len")).alias("identity"), (F.sum(F.col("mapq") * bp) / F.sum(bp)).alias("mapq"), (F.greatest(plus, F.sum(bp) - plus) / F.sum(bp)).alias("strand_share")
    )
    return out.withColumn("score", F.col("bases") * F.col("identity") * F.col("strand_share"))


def pair_metrics(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """true_positive, false_positive, false_negative, precision and recall of unordered pairs a, b."""
    canon = lambda df, name: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(name, F.lit(1))
    both = canon(expected, "e").join(canon(predicted, "p"), ["a", "b"], "full_outer")
    tp, fp, fn = F.sum((F.col("e").isNotNull() & F.col("p").isNotNull()).cast("long")), F.sum(F.col("e").isNull().cast("long")), F.sum(F.col("p").isNull().cast("long"))
    return both.agg(tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative")).select("*", (F.col("true_positive") / (F.col("true_positive") + F.col("false_positive"))).alias("precision"), (F.col("true_positive") / (F.col("true_positive") + F.col("false_negative"))).alias("recall"))


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper bound of the score interval of a proportion; null without trials."""
    n = F.when(trials > 0, trials.cast("double"))
    p, zz = successes / n, z * z
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))


def occupancy_conflicts(layout: DataFrame, cell: int = 1_000_000) -> DataFrame:
    """Pairs of placements, a < b, of one source that share source bases, with these bases.

    They meet in the cell of ``cell`` source bases where their overlap begins, so that pieces of a long source aren't all held
    against each other.
    """
    spread = layout.filter("source_start < source_end").withColumn("_cell", F.explode(F.expr(f"sequence(source_start div {cell}, (source_end - 1) div {cell})")))
    side = lambda n: spread.select("source_id", "_cell", F.col("block_id").alias(n), F.col("source_start").alias(f"{n}s"), F.col("source_end").alias(f"{n}e"))
    shared = overlap(F.col("as"), F.col("ae"), F.col("bs"), F.col("be"))
    met = side("a").join(side("b"), ["source_id", "_cell"]).filter("a < b").withColumn("shared", shared).filter("shared > 0")
    return met.filter(F.expr(f"_cell = greatest(as, bs) div {cell}")).select("source_id", "a", "b", "shared")


def boundaries(layout: DataFrame) -> DataFrame:
    """Places where a block could be put: before the first of an object, between neighbours, behind the last."""
    w = Window.partitionBy("object_id").orderBy("ord")
    left = layout.select("object_id", F.lag("block_id").over(w).alias("left_id"), F.col("block_id").alias("right_id"), F.col("visual_start").alias("at"))
    last = layout.withColumn("_next", F.lead("block_id").over(w)).filter("_next IS NULL").select("object_id", F.col("block_id").alias("left_id"), F.lit(None).cast("long").alias("right_id"), F.col("visual_end").alias("at"))
    return left.unionByName(last)


def line_distribution(points: DataFrame) -> DataFrame:
    """Per pair and line: weight, effective count (sum of weights squared over sum of squared weights) and the span of places.

    ``points`` has source, target, line, place and weight.
    """
    w = F.sum("weight")
    return points.groupBy("source", "target", "line").agg(w.alias("weight"), (w * w / F.sum(F.col("weight") * F.col("weight"))).alias("effective"), (F.max("place") - F.min("place") + 1).alias("span"), F.countDistinct("place").alias("places"))


def band_scores(modes: DataFrame, radius: int = 1) -> DataFrame:
    """Per pair and line: the mode whose band of 2 * radius + 1 modes weighs most, and its enrichment over an even spread.

    The band's sum is a range window over modes, so absent modes count 0; ties go to the lowest mode.
    """
    key = ["source", "target", "line"]
    band = F.sum("weight").over(Window.partitionBy(*key).orderBy("mode").rangeBetween(-radius, radius))
    total, lo, hi = (f.over(Window.partitionBy(*key)) for f in (F.sum("weight"), F.min("mode"), F.max("mode")))
    rated = modes.withColumn("band", band).withColumn("expected", total * (2 * radius + 1) / F.greatest(hi - lo + 1, F.lit(2 * radius + 1)))
    k = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("band").desc(), "mode"))
    return rated.withColumn("_k", k).filter("_k = 1").select(*key, "mode", "band", (F.col("band") / F.col("expected")).alias("enrichment"))
