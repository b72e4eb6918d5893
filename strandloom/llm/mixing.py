"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent and normalised. The exponent
is bisected: it is the largest that reaches a target entropy, unless a source would then
be repeated too often. The weights times a token budget give each source's quota, which
is realised as whole passes over the source and one partial pass over its blocks in a
permuted order. Sources are rows of a table throughout, so they may be as many as hosts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.sizes import small
from strandloom.functions.storage import materialise

#: Tokens of a block about; steps of the bisection, and how many of them one pass over the sources takes.
BLOCK_TOKENS, STEPS, AT_ONCE = 250_000, 40, 5
_OWN = ("mix_source", "mix_pass", "mix_block", "mix_rank")


def hash60(*parts: Column) -> Column:
    """60 bits of the md5 of the parts, joined by colons; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def power_sums(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent a: the sums of p^a and of p^a ln p over the column ``p``, in one aggregation."""
    if not exponents:
        return {}
    raised = F.pow("p", "a")
    rows = shares.select("p", F.explode(F.array(*map(F.lit, sorted(set(exponents))))).alias("a")).groupBy("a").agg(F.sum(raised).alias("s"), F.sum(raised * F.ln("p")).alias("t")).collect()
    return {r["a"]: (r["s"], r["t"]) for r in rows}  # a row for each exponent


def bisect_together(shares: DataFrame, tests: list[Callable[[float, float, float], bool]]) -> list[float]:
    """For each test of (exponent, sum of p^a, sum of p^a ln p): the border in [0, 1] below which it is false, to STEPS halvings.

    A pass over the shares evaluates the exponents at which the next AT_ONCE halvings may look.
    """
    borders = [(0.0, 1.0)] * len(tests)
    for _ in range(STEPS // AT_ONCE):
        grids = [[low + (high - low) * k / 2**AT_ONCE for k in range(1, 2**AT_ONCE)] for low, high in borders]
        sums = power_sums(shares, [a for grid in grids for a in grid])
        for i, (test, grid) in enumerate(zip(tests, grids, strict=True)):
            first, last = 0, len(grid)  # the border lies between grid[first - 1] and grid[last]
            while first < last:
                middle = (first + last) // 2
                first, last = (first, middle) if test(grid[middle], *sums[grid[middle]]) else (middle + 1, last)
            low, high = borders[i]
            borders[i] = (grid[first - 1] if first else low, grid[first] if first < len(grid) else high)
    return [high for _, high in borders]


def plan_mixture(totals: DataFrame, entropy_share: float, max_passes: float, budget_share: float | None = None) -> tuple[DataFrame, float]:
    """src, n, weight and quota of each source of ``totals`` (src, n), and the exponent.

    The exponent in [0, 1] reaches entropy_share of the greatest possible entropy; it is raised as far as needed for
    no source to be used more than max_passes times. The budget is budget_share times all tokens; without one it is
    the least that leaves no source under one pass. Sources without tokens have weight and quota 0.
    """
    live = totals.filter("n > 0")
    all_of = live.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("sources")).first()
    if not all_of["sources"]:
        return totals.select("src", "n", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota")), 1.0
    total, least, spread = all_of["n"], all_of["least"] / all_of["n"], all_of["most"] / all_of["least"]
    shares = live.select("src", "n", (F.col("n").cast("double") / F.lit(float(total))).alias("p"))
    goal = entropy_share * math.log(all_of["sources"])

    def enough(a: float, s: float, t: float) -> bool:  # false where the entropy is reached
        return math.log(s) - a * t / s < goal

    def bearable(a: float, s: float, t: float) -> bool:
        passes = spread ** (1 - a) if budget_share is None else budget_share * least ** (a - 1) / s
        return passes <= max_passes

    alpha = round(max(bisect_together(shares, [enough, bearable])), 9) if all_of["sources"] > 1 else 1.0
    weighted = shares.withColumn("weight", F.pow("p", F.lit(alpha)) / F.lit(power_sums(shares, [alpha])[alpha][0]))
    if budget_share is None:
        budget = weighted.agg(F.max(F.col("n") / F.col("weight")).alias("b")).first()["b"]
        quota = F.greatest("n", F.rint(F.col("weight") * F.lit(budget)).cast("long"))
    else:
        quota = F.rint(F.col("weight") * F.lit(budget_share * total)).cast("long")
    rest = totals.filter("n <= 0").select("src", "n", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    return weighted.select("src", "n", "weight", quota.alias("quota")).unionByName(rest), alpha


def mix_sources(docs: DataFrame, entropy_share: float = 0.97, max_passes: float = 1.5, budget_share: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """One row for each use of a row of ``docs`` in the mixture: its columns, then mix_source, mix_pass, mix_block and mix_rank.

    A source's quota is filled by floor(quota / tokens) whole passes and then by blocks in the order of a hash of the
    seed, the source and the block, as long as they fit; of the block that doesn't, rows by the hash of their id as
    long as they fit. A budget below the corpus thins large sources; without a budget each row is used at least once.
    mix_rank is the hash by which a reader orders the rows of a pass. A null source is a source of its own; texts
    that are null or without words count 0 tokens and are used in every whole pass, once at least; a mix_* column of
    ``docs`` is replaced; repeated rows share their fate, and of rows of one id those with fewer tokens come first;
    an empty table gives an empty one. No source and no text reaches the driver, sums do. The plan, a row for each
    source, is broadcast behind a check of its size; beyond it, the texts are shuffled to it.
    """
    own = [c for c in docs.columns if c not in _OWN]
    rows = docs.select(F.struct(*own).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("\0null")).alias("src"), F.col("doc_id").alias("id"), word_count(F.col("text")).alias("tok"))
    counts = materialise(rows.select("src", "id", "tok"), "counts")  # the texts are counted once for all that follows
    totals = materialise(counts.groupBy("src").agg(F.sum("tok").alias("n")), "totals")
    planned, _ = plan_mixture(totals, entropy_share, max_passes, budget_share)
    whole = F.when(F.col("n") > 0, F.floor(F.col("quota") / F.greatest(F.lit(1), "n"))).otherwise(0).cast("long")
    plan = planned.select("src", "n", "quota", whole.alias("whole"), F.greatest(F.lit(1), F.ceil(F.col("n") / block_tokens)).cast("long").alias("blocks"))
    plan = materialise(plan.withColumn("rest", F.when(F.col("n") > 0, F.col("quota") - F.col("whole") * F.col("n")).otherwise(0)).select("src", "whole", "rest", "blocks"), "plan")
    turn = hash60(F.lit(seed + 1), F.col("src"), F.col("block"))

    def deal(df: DataFrame, plan: DataFrame) -> DataFrame:
        return df.join(small(plan), "src").withColumn("rank", hash60(F.lit(seed), F.col("src"), F.col("id"))).withColumn("block", F.col("rank") % F.col("blocks"))

    dealt = deal(counts, plan)
    # blocks of the partial pass: sums alone, in runs of the permuted order and then inside each run
    sums = dealt.groupBy("src", "block", "rest").agg(F.sum("tok").alias("tok")).withColumn("turn", turn).withColumn("run", F.shiftright("turn", 50))
    sums = materialise(sums, "blocks")
    runs = sums.groupBy("src", "run").agg(F.sum("tok").alias("run_tok"))
    before = F.sum("run_tok").over(Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("run_tok")
    upto = F.sum("tok").over(Window.partitionBy("src", "run").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, 0))
    placed = sums.join(runs.select("src", "run", before.alias("before")), ["src", "run"]).withColumn("room", F.col("rest") - F.col("before") - upto + F.col("tok")).filter("room > 0")
    placed = materialise(placed.select("src", "block", "turn", "tok", "room"), "placed")
    last = placed.filter("tok <= room").groupBy("src").agg(F.max(F.struct("turn", "block")).alias("last"))
    edge = placed.filter("tok > room").select("src", F.col("block").alias("edge"), F.col("room"))  # one block for each source
    within = Window.partitionBy("src").orderBy("rank", "id", "tok").rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.select("src", "block", "id", "rank", "tok").join(small(edge), "src").filter("block = edge AND tok > 0").withColumn("sum", F.sum("tok").over(within))
    cut = inside.filter(F.col("sum") <= F.col("room")).groupBy("src").agg(F.max(F.struct("rank", "id", "tok")).alias("cut"))
    bounds = plan.join(last, "src", "left").join(edge.drop("room"), "src", "left").join(cut, "src", "left")
    joined = deal(rows, materialise(bounds, "bounds"))
    extra = F.when(F.struct(turn.alias("turn"), "block") <= F.col("last"), 1).when((F.col("block") == F.col("edge")) & (F.struct("rank", "id", "tok") <= F.col("cut")), 1).otherwise(0)
    uses = joined.withColumn("uses", F.when(F.col("tok") > 0, F.col("whole") + extra).otherwise(F.greatest(F.lit(1).cast("long"), "whole")).cast("long")).filter("uses > 0")
    return uses.withColumn("mix_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses")))).select(
        "row.*", F.nullif(F.col("src"), F.lit("\0null")).alias("mix_source"), "mix_pass", F.col("block").alias("mix_block"), hash60(F.lit(seed), F.col("mix_pass"), F.col("id")).alias("mix_rank")
    )
