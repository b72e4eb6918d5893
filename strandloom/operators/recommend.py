"""Where an unplaced or misplaced block fits: junctions, anchors, matching, clusters, issues."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.runs import fold_groups


def junction_scores(quadrants: DataFrame) -> DataFrame:
    """source, target, the best joining of ends, and log2((signal + 1) / (background + 1)).

    The signal is the greatest quadrant, ties to ll, lr, rl, rr in turn; the background the mean of the others.
    """
    parts = F.array(*[F.struct(F.col(q).alias("v"), F.lit(-i).alias("neg"), F.lit(q).alias("q")) for i, q in enumerate(("ll", "lr", "rl", "rr"))])
    best = quadrants.withColumn("best", F.array_max(parts)).withColumn("total", F.col("ll") + F.col("lr") + F.col("rl") + F.col("rr"))
    return best.select("source", "target", F.col("best.q").alias("ends"), F.log2((F.col("best.v") + 1) / ((F.col("total") - F.col("best.v")) / 3 + 1)).alias("score"))


def primary_anchors(loci: DataFrame, query_len: DataFrame, coverage: float = 0.5, identity: float = 0.7, mapq: float = 1, dominance: float = 0.75) -> DataFrame:
    """Each query's best locus and why it is no anchor: coverage, identity, mapq or dominance, the first that fails.

    ``loci`` has query_name, target_name, bases, identity, mapq and score; ``query_len`` query_name and query_len.
    """
    total = F.sum("score").over(Window.partitionBy("query_name"))
    rank = F.row_number().over(Window.partitionBy("query_name").orderBy(F.col("score").desc(), "target_name"))
    best = loci.withColumn("dominance", F.col("score") / total).withColumn("_k", rank).filter("_k = 1").join(query_len, "query_name")
    cover = F.least(F.lit(1.0), F.col("bases") / F.col("query_len"))
    reason = F.when(cover < coverage, "coverage").when(F.col("identity") < identity, "identity").when(F.col("mapq") < mapq, "mapq").when(F.col("dominance") < dominance, "dominance").otherwise("anchor")
    return best.select("query_name", "target_name", "dominance", cover.alias("coverage"), reason.alias("status"))


def best_pairing(scores: list[list[float]]) -> list[int]:
    """Column of each row in the pairing of greatest total, -1 where a row has none; pairs of score 0 don't count."""
    rows, cols = len(scores), max(map(len, scores), default=0)
    n = max(rows, cols)
    cost = [[-(scores[i][j] if i < rows and j < len(scores[i]) else 0.0) for j in range(n)] for i in range(n)]
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        match[n], j0 = i, n
        low, back, used = [float("inf")] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while match[j0] != n or j0 == n:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), n
            for j in range(n):
                if not used[j]:
                    c = cost[i0][j] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], back[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
        while j0 != n:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    out = [-1] * rows
    for j in range(n):
        i = match[j]
        if i < rows and j < cols and j < len(scores[i]) and scores[i][j] > 0:
            out[i] = j
    return out


def pair_groups(scores: DataFrame) -> DataFrame:
    """group, row, column and score of the pairing of greatest total in each group of (group, row, column, score)."""

    def body(group: list[dict]) -> Iterable[tuple]:
        rows, cols = sorted({r["row"] for r in group}), sorted({r["column"] for r in group})
        table = [[0.0] * len(cols) for _ in rows]
        for r in group:
            table[rows.index(r["row"])][cols.index(r["column"])] = r["score"]
        return [(group[0]["group"], rows[i], cols[j], table[i][j]) for i, j in enumerate(best_pairing(table)) if j >= 0]

    return fold_groups(scores.select("group", "row", "column", "score"), ["group"], ["row", "column"], body, "group long, row long, column long, score double")


def linkage_clusters(anchors: DataFrame, minimum: float = 0.5) -> DataFrame:
    """target, anchor and cluster: each anchor, in order, joins the cluster with the greatest least overlap, of ``minimum`` or more.

    Overlap is of the shorter of two intervals. Anchors of a target come by start, end and id; ties go to the older
    cluster. Runs of anchors that touch no later one are folded by themselves, which bounds the group.
    """
    w = Window.partitionBy("target").orderBy("start", "end", "anchor")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def body(group: list[dict]) -> Iterable[tuple]:
        clusters: list[list[dict]] = []
        for r in group:
            best, at = -1.0, -1
            for k, members in enumerate(clusters):
                least = min((min(r["end"], m["end"]) - max(r["start"], m["start"])) / max(1, min(r["end"] - r["start"], m["end"] - m["start"])) for m in members)
                if least >= minimum and least > best:
                    best, at = least, k
            if at < 0:
                clusters.append([r])
            else:
                clusters[at].append(r)
        return [(group[0]["target"], m["anchor"], members[0]["anchor"]) for members in clusters for m in members]

    marked = anchors.select("target", "anchor", "start", "end", island.alias("island"))
    return fold_groups(marked, ["target", "island"], ["start", "end", "anchor"], body, "target long, anchor long, cluster long")


def curation_issues(links: DataFrame, layout: DataFrame, limit: int = 40) -> DataFrame:
    """The first issues by kind: links between neighbours that don't face each other, links over a gap, copies, unplaced neighbours.

    ``links`` has from_segment, from_side, to_segment, to_side and line_no.
    """
    counts = layout.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("object_id").orderBy("ord")
    single = layout.withColumn("_pos", F.row_number().over(w)).join(counts, "source_id")
    side = lambda p: single.select(F.col("source_id").alias(f"{p}_segment"), F.col("object_id").alias(f"{p}_object"), F.col("_pos").alias(f"{p}_pos"), F.col("orientation").alias(f"{p}_o"), F.col("n").alias(f"{p}_n"))
    both = links.join(side("from"), "from_segment", "left").join(side("to"), "to_segment", "left")
    shown = lambda p: F.when((F.col(f"{p}_o") == "-") == (F.col(f"{p}_side") == "start"), "right").otherwise("left")
    near = (F.col("from_object") == F.col("to_object")) & (F.abs(F.col("from_pos") - F.col("to_pos")) == 1)
    first_is_from = F.col("from_pos") < F.col("to_pos")
    faces = F.when(first_is_from, (shown("from") == "right") & (shown("to") == "left")).otherwise((shown("from") == "left") & (shown("to") == "right"))
    kind = (
        F.when((F.col("from_n") > 1) | (F.col("to_n") > 1), F.struct(F.lit(3).alias("priority"), F.lit("copy-ambiguity").alias("kind")))
        .when(F.col("from_n").isNull() | F.col("to_n").isNull(), F.struct(F.lit(2).alias("priority"), F.lit("unplaced-neighbour").alias("kind")))
        .when(near & ~faces, F.struct(F.lit(0).alias("priority"), F.lit("orientation-conflict").alias("kind")))
        .when(~near & (F.col("from_object") == F.col("to_object")), F.struct(F.lit(1).alias("priority"), F.lit("off-backbone").alias("kind")))
    )
    rated = both.withColumn("k", kind).filter("k IS NOT NULL").select(F.col("k.priority").alias("priority"), F.col("k.kind").alias("kind"), "line_no", "from_segment", "to_segment").distinct()
    return rated.orderBy("priority", "line_no", "kind").limit(limit)


def layout_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """object_id and blocks that an edit changed: moved, cut, turned, added or removed."""
    columns = ["block_id", "object_id", "source_id", "source_start", "source_end", "orientation", "ord"]
    gone, new = before.select(*columns).exceptAll(after.select(*columns)), after.select(*columns).exceptAll(before.select(*columns))
    return gone.unionByName(new).groupBy("object_id").agg(F.countDistinct("block_id").alias("blocks"), F.countDistinct("source_id").alias("sources"))


def tiers(links: DataFrame, selected: DataFrame | None, conflicts: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """selected, partner, tier and the other columns of ``links`` (source, target) for both ends of each link, or with ``selected`` for those in it; see ``tiered_partners``."""
    rest = [c for c in links.columns if c not in ("source", "target")]
    end = lambda a, b: F.struct(F.col(a).alias("selected"), F.col(b).alias("partner"))
    ends = links.select(F.explode(F.array(end("source", "target"), end("target", "source"))).alias("_e"), *rest).select("_e.*", *rest)  # of one scan
    held, by = ends if selected is None else ends.join(selected, "selected", "left_semi"), "partner"
    if layout is not None:
        held, by = held.join(layout.select(F.col("block_id").alias("partner"), "object_id"), "partner", "left"), "object_id"
    own = held.join(conflicts.select("selected", by).distinct().withColumn("_c", F.lit(1)), ["selected", by], "left")
    return own.select("selected", "partner", *rest, F.coalesce("_c", F.lit(0)).alias("tier"))


def tiered_partners(links: DataFrame, selected: DataFrame, conflicts: DataFrame, k: int, layout: DataFrame | None = None) -> DataFrame:
    """selected, partner, score, tier and rank: the k best compatible partners (tier 0) and the k best conflicting ones (tier 1).

    ``links`` has source, target and score; ``selected`` selected; ``conflicts`` selected and partner or, with a layout, selected
    and object_id: then a partner conflicts if its object does, and nothing is spread over an object's blocks. Ties go to the smaller partner.
    """
    tier = tiers(links.select("source", "target", "score"), selected, conflicts, layout)
    rank = F.row_number().over(Window.partitionBy("selected", "tier").orderBy(F.col("score").desc(), "partner"))
    return tier.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("selected", "partner", "score", "tier", "rank")


def placement_candidates(partners: DataFrame, boundaries: DataFrame, *also: str) -> DataFrame:
    """selected, object_id, left_id, right_id and orientation: both ways round, at every boundary beside a partner.

    Boundaries that touch the selected block itself are left out; ``also`` are further columns of boundaries.
    """
    beside = boundaries.select("*", F.explode(F.array_compact(F.array("left_id", "right_id"))).alias("partner"))
    hit = partners.select("selected", "partner").join(beside, "partner").filter(~F.col("left_id").eqNullSafe(F.col("selected")) & ~F.col("right_id").eqNullSafe(F.col("selected")))
    once = hit.select("selected", "object_id", "left_id", "right_id", *also).distinct()
    return once.withColumn("orientation", F.explode(F.array(F.lit("+"), F.lit("-"))))
