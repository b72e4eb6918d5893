"""Knight-Ruiz balancing with its search for a support that can be balanced.

A matrix can only be balanced on bins that have enough neighbours. Coverage percentiles are tried in turn; each gives a
support, and supports of the size of the one before are passed over. On a support the inner-outer Newton iteration of
Knight and Ruiz runs as Spark jobs: vectors are DataFrames, a product is a join and a sum over the pixels, and only inner
products reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise
from strandloom.operators.balance import both_triangles, keep_total, product, row_sums

#: Percentiles of coverage, the converter's one more, products of an attempt and of the last one.
PERCENTILES, MORE_PERCENTILES, PRODUCTS, LAST_PRODUCTS = (0.0, 1.0, 2.0, 3.0, 4.0, 10.0), (15.0,), 64, 5_000
#: Squared norm of 1 minus the marginals, steps of the outer and inner loop, outer steps without progress.
TARGET, OUTER, INNER, STAGNANT = 1e-12, 100, 200, 20
#: Rounds of peeling, steps of the first balancing, and the greatest logarithm of a weight to start from.
PEEL_ROUNDS, PREBALANCE, MOST_LOG = 16, 16, 18.420680743952367
_DELTA, _GAMMA, _ETA, _EPSILON = 0.1, 0.9, 0.1, 1e-15


class NotBalanced(ValueError):
    """Why an attempt failed, and the weights that it had come to."""

    def __init__(self, why: str, weights: DataFrame | None = None) -> None:
        super().__init__(why)
        self.weights = weights


def positive_percentile(df: DataFrame, value: str, percent: float) -> float:
    """The percentile of positive finite values, between neighbours in proportion; 0 for percent 0 or without values."""
    if percent <= 0:
        return 0.0
    live = df.filter((F.col(value) > 0) & (F.col(value) < float("inf")) & ~F.isnan(F.col(value).cast("double")))
    return float(live.agg(F.percentile(value, F.lit(min(percent, 100.0) / 100))).first()[0] or 0.0)


def active_support(pixels: DataFrame, cover: DataFrame, threshold: float) -> DataFrame:
    """bin_id of the bins that are covered above the threshold and have a neighbour that is, which may be themselves."""
    above = cover.filter((F.col("total") > threshold) & (F.col("total") < float("inf"))).select("bin_id")
    return both_triangles(within(pixels, above)).select(F.col("i").alias("bin_id")).distinct()


def within(pixels: DataFrame, active: DataFrame) -> DataFrame:
    """Pixels of which both bins are active."""
    ends = [active.select(F.col("bin_id").alias(c)) for c in ("bin1_id", "bin2_id")]
    return pixels.join(ends[0], "bin1_id", "left_semi").join(ends[1], "bin2_id", "left_semi")


def peel_leaves(pixels: DataFrame, rounds: int = PEEL_ROUNDS) -> DataFrame:
    """Pixels without bins that have one neighbour only, where that one has others: such a leaf can't be balanced.

    What is peeled may bare further leaves, for so many rounds. Bins with nothing but themselves, and pairs with nothing but
    each other, stay.
    """
    left = materialise(pixels.select("bin1_id", "bin2_id", "count"), "peeled")
    for _ in range(rounds):
        near = both_triangles(left).groupBy("i").agg(F.count(F.lit(1)).alias("degree"), F.max("j").alias("only"))
        hubs = near.select(F.col("i").alias("only"), F.col("degree").alias("others"))
        leaves = materialise(near.filter("degree = 1 AND only <> i").join(hubs, "only").filter("others > 1").select(F.col("i").alias("bin_id")), "leaves")
        if leaves.isEmpty():
            break
        for end in ("bin1_id", "bin2_id"):
            left = left.join(leaves.withColumnRenamed("bin_id", end), end, "left_anti")
        left = materialise(left.select("bin1_id", "bin2_id", "count"), "peeled")
    return left


def prebalance(pixels: DataFrame, weights: DataFrame, steps: int = PREBALANCE) -> DataFrame:
    """weights after so many steps of dividing each by the root of its marginal."""
    matrix = materialise(both_triangles(pixels), "matrix")
    for _ in range(steps):
        met = weights.join(product(matrix, weights), "bin_id", "left").withColumn("m", F.col("w") * F.coalesce("value", F.lit(0.0)))
        weights = materialise(met.select("bin_id", F.when(F.col("m") > _EPSILON, F.col("w") / F.sqrt("m")).otherwise(F.col("w")).alias("w")), "prebalanced")
    return weights


def warm_start(weights: DataFrame, active: DataFrame) -> DataFrame:
    """Weights of an earlier attempt on a support: 1 where it has none, centred by their geometric mean, neither too large nor small."""
    known = active.join(weights, "bin_id", "left").select("bin_id", F.log(F.coalesce("w", F.lit(1.0))).alias("log"))
    middle = known.agg(F.avg("log")).first()[0] or 0.0
    return known.select("bin_id", F.exp(F.least(F.greatest(F.col("log") - middle, F.lit(-MOST_LOG)), F.lit(MOST_LOG))).alias("w"))


def _sums(state: DataFrame, *values: Column) -> list[float]:
    return [x if x is not None else 0.0 for x in state.agg(*values).first()]


def newton(pixels: DataFrame, start: DataFrame, products: int = LAST_PRODUCTS, target: float = TARGET) -> DataFrame:
    """bin_id and w with all marginals 1, from ``start`` (bin_id, w); else NotBalanced.

    Fails where the products are used up, a marginal or a step isn't positive, or the residual has stayed the same for
    STAGNANT steps.
    """
    matrix, used = materialise(both_triangles(pixels), "matrix"), 0

    def times(state: DataFrame, weight: Column, keep: list[str]) -> DataFrame:
        nonlocal used
        used += 1
        if used > products:
            raise NotBalanced(f"not balanced after {products} products", x)
        met = product(matrix, state.select("bin_id", weight.alias("w")))
        return state.select("bin_id", *keep).join(met, "bin_id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))

    def opened(x: DataFrame) -> tuple[DataFrame, float]:
        met = times(x, F.col("w"), ["w"]).withColumn("v", F.col("value") * F.col("w"))
        state = materialise(met.select("bin_id", "w", "v", (1 - F.col("v")).alias("r"), F.lit(1.0).alias("y"), F.lit(0.0).alias("d")), "newton")
        least, rho = _sums(state, F.min(F.when(F.isnan("v"), 0.0).otherwise(F.col("v"))), F.sum(F.col("r") * F.col("r")))
        if state.isEmpty() or least <= _EPSILON:
            raise NotBalanced("a bin's marginal isn't positive", x)
        return state, rho

    x = start.select("bin_id", F.col("w").cast("double").alias("w"))
    state, outer = opened(x)
    before, eta, still = outer, _ETA, 0
    for _ in range(OUTER):
        if outer <= target:
            return x
        goal, rho, last = max(eta * eta * outer, target), outer, outer
        for step in range(INNER):
            if rho <= goal:
                break
            z = F.col("r") / F.col("v")
            rho = _sums(state, F.sum(F.col("r") * z))[0] if step == 0 else rho
            direction = z if step == 0 else z + F.lit(rho / last) * F.col("d")
            turned = state.withColumn("d", direction)
            met = times(turned, F.col("w") * F.col("d"), ["w", "v", "r", "y", "d"])
            state = materialise(met.withColumn("q", F.col("w") * F.col("value") + F.col("v") * F.col("d")).drop("value"), "newton")
            slope = _sums(state, F.sum(F.col("d") * F.col("q")))[0]
            if not slope > _EPSILON:
                raise NotBalanced("a step's slope isn't positive", x)
            alpha = rho / slope
            by = F.lit(alpha) * F.col("d")
            lowest, room, following = state.agg(F.min(F.col("y") + by), F.min(F.when(by < 0, (_DELTA - F.col("y")) / by)), F.sum((F.col("r") - F.lit(alpha) * F.col("q")) * (F.col("r") - F.lit(alpha) * F.col("q")) / F.col("v"))).first()
            if lowest <= _DELTA:  # the step ends where the first weight would leave the positive cone
                if room is None or room <= 0:
                    raise NotBalanced("no step keeps the weights positive", x)
                state = state.withColumn("y", F.col("y") + F.lit(room) * by)
                break
            state = state.withColumn("y", F.col("y") + by).withColumn("r", F.col("r") - F.lit(alpha) * F.col("q")).drop("q")
            last, rho = rho, following
        x = materialise(state.select("bin_id", (F.col("w") * F.col("y")).alias("w")), "weights")
        state, rho = opened(x)
        still = still + 1 if abs(rho - outer) <= 1e-12 * max(outer, 1.0) else 0
        if still >= STAGNANT:
            raise NotBalanced(f"no progress in {STAGNANT} steps", x)
        outer = rho
        ratio, before = (outer / before if before > _EPSILON else 0.0), outer
        squared = _GAMMA * eta * eta
        eta = max(_GAMMA * ratio, squared if squared > 0.1 else 0.0, 0.5 * target**0.5 / outer**0.5 if outer**0.5 > _EPSILON else 0.0)
        eta = min(eta, _ETA)
    if outer <= target:
        return x
    raise NotBalanced(f"not balanced after {OUTER} steps", x)


def knight_ruiz_ladder(pixels: DataFrame, percentiles: tuple[float, ...] = PERCENTILES, products: int = PRODUCTS, last_products: int = LAST_PRODUCTS, peel: bool = False, rescale: bool = True) -> tuple[DataFrame, list[dict]]:
    """Weights (bin_id, w) of the first support that can be balanced, and what was tried: percent, bins, and failure or None.

    Bins outside of the support have no weight. With ``peel`` leaves go from each support, and the last attempt starts from the
    weights of an earlier one that ran out of products, balanced a little first. ``rescale`` keeps the matrix's total. Where every
    support fails, the last failure is raised; a matrix without positive counts gives no weights.
    """
    held = materialise(pixels.select("bin1_id", "bin2_id", "count"), "pixels")
    cover = materialise(row_sums(held), "coverage")
    tried: list[dict] = []
    if cover.isEmpty():
        return cover.select("bin_id", F.lit(1.0).alias("w")), tried
    failed, size, warm = None, None, None
    for k, percent in enumerate(percentiles):
        inner = within(held, active_support(held, cover, positive_percentile(cover, "total", percent)))
        inner = peel_leaves(inner) if peel else materialise(inner, "support")
        active = materialise(both_triangles(inner).select(F.col("i").alias("bin_id")).distinct(), "active")
        count = active.count()
        if count == size:
            continue
        size, last = count, k + 1 == len(percentiles)
        start = active.select("bin_id", F.lit(1.0).alias("w"))
        if peel and last and warm is not None:
            start = prebalance(inner, materialise(warm_start(warm, active), "warm"))
        try:
            weights = newton(inner, start, last_products if last else products)
        except NotBalanced as why:
            failed, warm = why, why.weights if "products" in str(why) else warm
            tried.append({"percent": percent, "bins": count, "failure": str(why)})
            continue
        tried.append({"percent": percent, "bins": count, "failure": None})
        return (keep_total(inner, weights) if rescale else weights), tried
    raise failed if failed is not None else NotBalanced("no bin is active")


def stored_methods(resolution: int, least: int = 5_000) -> tuple[str, ...]:
    """Methods whose weights a level stores: Knight-Ruiz only where bins are ``least`` bases or longer."""
    return ("VC", "VC_SQRT", "ICE", "KR") if resolution >= least else ("VC", "VC_SQRT", "ICE")
