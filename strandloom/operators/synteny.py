"""Alignments chained, filtered, arbitrated and projected through the layout."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.intervals import overlap
from strandloom.functions.runs import fold_groups
from strandloom.functions.sizes import small_once
from strandloom.functions.storage import materialise
from strandloom.operators.layout import visual_interval

_CHAIN = "query_name long, target_name long, strand string, query_start long, query_end long, target_start long, target_end long, matches long, block_len long, mapq int, fragments int, aligned long"


#: Bases of a cell in which pieces of a query meet the alignments over them.
CELL = 16_384


class _PrefixBest:
    """Greatest value among the keys up to a bound, as values are added one by one (a binary indexed tree)."""

    def __init__(self, size: int):
        self.cells: list[tuple | None] = [None] * (size + 1)

    def add(self, at: int, value: tuple) -> None:
        at += 1
        while at < len(self.cells):
            if self.cells[at] is None or value > self.cells[at]:
                self.cells[at] = value
            at += at & -at

    def upto(self, count: int) -> tuple | None:
        best = None
        while count:
            if self.cells[count] is not None and (best is None or self.cells[count] > best):
                best = self.cells[count]
            count -= count & -count
        return best


def _best_chain(rows: list[tuple]) -> list[tuple]:
    """Fragments of the best collinear chain of (query start, end, target start, end, matches, length, mapq).

    Chains compare by aligned target bases, matches, length, mapq times length, then fewer fragments. A fragment
    follows another if it begins behind its effective end in query and target, which is the end less at most 1,000
    bases or half the span. Fragments come by query start; those whose effective end lies behind wait in a heap.
    """
    rows = sorted(rows)
    cut = [(r[1] - min(1000, (r[1] - r[0]) // 2), r[3] - min(1000, (r[3] - r[2]) // 2)) for r in rows]
    ends = sorted({c[1] for c in cut})
    tree, waiting = _PrefixBest(len(ends)), []
    best: list[tuple] = []
    before = [-1] * len(rows)
    for i, r in enumerate(rows):
        while waiting and waiting[0][0] <= r[0]:
            _, j = heappop(waiting)
            tree.add(bisect_left(ends, cut[j][1]), (best[j], -j))
        own = (r[3] - r[2], r[4], r[5], r[6] * r[5], -1)
        found = tree.upto(bisect_right(ends, r[2]))
        if found is not None:
            before[i] = -found[1]
            own = tuple(a + b for a, b in zip(found[0], own, strict=True))
        best.append(own)
        heappush(waiting, (cut[i][0], i))
    at, chain = max(range(len(rows)), key=lambda i: (best[i], -i)), []
    while at >= 0:
        chain.append(rows[at])
        at = before[at]
    return chain[::-1]


def chains(paf: DataFrame, minimum: int = 10_000) -> DataFrame:
    """The better strand's best chain of each query and target, merged, if it aligns ``minimum`` target bases.

    A group is the alignments of one query with one target; it holds what aligners emit for a pair of sequences.
    """

    def best(group: list[dict]) -> list[tuple]:
        found = []
        for strand in ("+", "-"):
            part = [r for r in group if r["strand"] == strand]
            if not part:
                continue
            ends = [(r["target_start"], r["target_end"]) if strand == "+" else (-r["target_end"], -r["target_start"]) for r in part]
            chain = _best_chain([(r["query_start"], r["query_end"], *e, r["matches"], r["block_len"], r["mapq"]) for r, e in zip(part, ends, strict=True)])
            score = (sum(r[3] - r[2] for r in chain), sum(r[4] for r in chain), sum(r[5] for r in chain), sum(r[6] * r[5] for r in chain), -len(chain))
            found.append((score, strand == "+", strand, chain))
        score, _, strand, chain = max(found, key=lambda x: x[:2])
        lo, hi = min(r[2] for r in chain), max(r[3] for r in chain)
        lo, hi = (-hi, -lo) if strand == "-" else (lo, hi)
        return [(group[0]["query_name"], group[0]["target_name"], strand, min(r[0] for r in chain), max(r[1] for r in chain), lo, hi, sum(r[4] for r in chain), sum(r[5] for r in chain), min(r[6] for r in chain), len(chain), score[0])]

    columns = ["query_name", "target_name", "strand", "query_start", "query_end", "target_start", "target_end", "matches", "block_len", "mapq"]
    key = ["query_name", "target_name"]
    counted = paf.select(*columns).withColumn("_alone", (F.count(F.lit(1)).over(Window.partitionBy(*key)) == 1) & F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)))
    single = counted.filter("_alone").withColumn("fragments", F.lit(1)).withColumn("aligned", F.col("target_end") - F.col("target_start"))  # a chain by itself, as most pairs have
    merged = fold_groups(counted.filter("NOT _alone").select(*columns), key, ["query_start", "query_end", "target_start", "target_end"], best, _CHAIN)
    return merged.unionByName(single.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in merged.schema])).filter(F.col("aligned") >= minimum)


def keep_near_best(rows: DataFrame, score: str = "aligned", share: int = 5) -> DataFrame:
    """Chains whose aligned bases are at least 1/share of their query's best."""
    return rows.withColumn("_best", F.max(score).over(Window.partitionBy("query_name"))).filter(F.col(score) * share >= F.col("_best")).drop("_best")


def arbitrate(rows: DataFrame) -> DataFrame:
    """Query intervals and the alignment that wins each: query_name, start, end, target_name, strand, aln_id.

    At any base the winner has the greatest mapq, then identity, matches, query length, then the smallest target,
    strand, target start and id. Neighbouring intervals of one winner are one.
    """
    # cut at the borders of cells, too, so that pieces, what covers them and the winners meet in a cell without further shuffles
    held = rows.filter("query_start < query_end").withColumn("_cell", F.explode(F.expr(f"sequence(query_start div {CELL}, (query_end - 1) div {CELL})")))
    ends = F.array(F.greatest("query_start", F.col("_cell") * CELL), F.least("query_end", (F.col("_cell") + 1) * CELL))
    cuts = held.select("query_name", "_cell", "query_start", "query_end").repartition("query_name", "_cell").select("query_name", "_cell", F.explode(ends).alias("at")).distinct()
    pieces = cuts.withColumn("stop", F.lead("at").over(Window.partitionBy("query_name", "_cell").orderBy("at"))).filter("stop IS NOT NULL")
    over = pieces.join(held, ["query_name", "_cell"]).filter((F.col("query_start") <= F.col("at")) & (F.col("query_end") >= F.col("stop")))
    identity = F.col("matches").cast("decimal(20,0)") / F.col("block_len").cast("decimal(20,0)")
    order = [F.col("mapq").desc(), identity.desc(), F.col("matches").desc(), (F.col("query_end") - F.col("query_start")).desc(), "target_name", "strand", "target_start", "aln_id"]
    winner = over.withColumn("_k", F.row_number().over(Window.partitionBy("query_name", "_cell", "at").orderBy(*order))).filter("_k = 1")
    in_cells = _runs_of(winner.select("query_name", "_cell", "target_name", "strand", "aln_id", F.col("at").alias("start"), F.col("stop").alias("end")), ["query_name", "_cell"])
    return _runs_of(in_cells.drop("_cell"), ["query_name"])


def _runs_of(won: DataFrame, key: list[str]) -> DataFrame:
    """Stretches that follow each other within a key and have one winner, joined."""
    w = Window.partitionBy(*key).orderBy("start")
    fresh = F.when((F.lag("aln_id").over(w) == F.col("aln_id")) & (F.lag("end").over(w) == F.col("start")), 0).otherwise(1)
    runs = won.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "_run", "target_name", "strand", "aln_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def preview(rows: DataFrame, retained) -> DataFrame:
    """One row: alignments, those that are retained and discarded, and the queries and targets of the retained ones."""
    own = lambda c: F.count_distinct(F.when(retained, F.col(c)))
    return rows.agg(F.count(F.lit(1)).alias("alignments"), F.count_if(retained).alias("retained"), F.count_if(~retained).alias("discarded"), own("query_name").alias("queries"), own("target_name").alias("targets"))


def consolidate(paf: DataFrame, minimum: int = 10_000) -> DataFrame:
    """Alignments consolidated: the best chain of each query and target, near-best chains of a query, and arbitration by interval.

    Each row is a stretch of a query and the chain that wins it, with the stretch's target interval by proportion
    along the strand, matches and length rescaled (1 at least), and the chain's mapq, fragments and aligned bases.
    """
    found = materialise(keep_near_best(chains(paf, minimum)).withColumn("aln_id", F.xxhash64("query_name", "target_name")), "chains")
    won = arbitrate(found).withColumnsRenamed({"start": "won_start", "end": "won_end"})
    rows = won.join(found, ["query_name", "target_name", "strand", "aln_id"])
    span, part = F.col("query_end") - F.col("query_start"), F.col("won_end") - F.col("won_start")
    target = F.col("target_end") - F.col("target_start")
    before, behind = F.col("won_start") - F.col("query_start"), F.col("query_end") - F.col("won_end")
    back = F.col("strand") == "-"
    along = lambda x: F.floor(x.cast("decimal(20,0)") * target.cast("decimal(18,0)") / span).cast("long")
    low = F.col("target_start") + along(F.when(back, behind).otherwise(before))
    high = F.greatest(low + 1, F.col("target_start") + along(F.when(back, span - before).otherwise(span - behind)))
    scaled = lambda c: F.greatest(F.lit(1), F.round(F.col(c) * part / span)).cast("long").alias(c)
    return rows.select("query_name", "target_name", "strand", F.col("won_start").alias("query_start"), F.col("won_end").alias("query_end"), low.alias("target_start"), high.alias("target_end"), scaled("matches"), scaled("block_len"), "mapq", "fragments", "aligned")


def project_alignments(rows: DataFrame, layout: DataFrame, min_mapq: int = 0, min_len: int = 0) -> DataFrame:
    """Alignments cut at the layout's blocks: visual interval, target interval by proportion, strand in view."""
    hit = rows.filter(F.col("mapq") >= min_mapq).join(small_once(layout, "layout"), (F.col("query_name") == F.col("source_id")) & (F.col("query_start") < F.col("source_end")) & (F.col("query_end") > F.col("source_start")))
    s, e = F.greatest("query_start", "source_start"), F.least("query_end", "source_end")
    vs, ve = visual_interval(s, e)
    span, target = (F.col("query_end") - F.col("query_start")).cast("decimal(20,0)"), (F.col("target_end") - F.col("target_start")).cast("decimal(18,0)")
    at = lambda x: (F.col("target_start") + F.floor((x - F.col("query_start")).cast("decimal(18,0)") * target / span)).cast("long")
    strand = F.when(F.col("orientation") == "-", F.when(F.col("strand") == "+", "-").otherwise("+")).otherwise(F.col("strand"))
    cut = hit.filter(overlap(F.col("query_start"), F.col("query_end"), F.col("source_start"), F.col("source_end")) >= max(1, min_len))
    return cut.select("block_id", "query_name", "target_name", strand.alias("strand"), vs.alias("visual_start"), ve.alias("visual_end"), at(s).alias("target_start"), at(e).alias("target_end"), "mapq")


_MERGED = "block_id long, query_name {name}, target_name {target}, strand string, visual_start long, visual_end long, target_start long, target_end long, mapq int, alignments long"


def merge_gaps(blocks: DataFrame, query_gap: int, target_gap: int) -> DataFrame:
    """Neighbours of a block, query, target and strand joined where both gaps are small, as a fold over their order.

    The target gap is to the extent merged so far, which grows both ways, so each group is folded in its order: by
    visual start, then target start.
    """
    key = ["block_id", "query_name", "target_name", "strand"]

    def body(group: list[dict]) -> list[tuple]:
        out: list[list] = []
        for r in group:
            if out:
                last = out[-1]
                gap = max(r["target_start"], last[2]) - min(r["target_end"], last[3])
                if r["visual_start"] - last[1] <= query_gap and gap <= target_gap:
                    last[1], last[2], last[3] = max(last[1], r["visual_end"]), min(last[2], r["target_start"]), max(last[3], r["target_end"])
                    last[4], last[5] = min(last[4], r["mapq"]), last[5] + 1
                    continue
            out.append([r["visual_start"], r["visual_end"], r["target_start"], r["target_end"], r["mapq"], 1])
        return [tuple(group[0][k] for k in key) + tuple(m) for m in out]

    types = dict(blocks.dtypes)
    rows = blocks.select(*key, "visual_start", "target_start", "visual_end", "target_end", "mapq")
    return fold_groups(rows, key, ["visual_start", "target_start", "visual_end", "target_end"], body, _MERGED.format(name=types["query_name"], target=types["target_name"]))
