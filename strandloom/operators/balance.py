"""Balancing a sparse symmetric matrix: coverage, VC, VC_SQRT, ICE and Knight-Ruiz.

Pixels have bin1_id <= bin2_id and count. Weights multiply counts; NaN-free: a bin that is
left out has no row. All products are joins and sums; iterations cut their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise


def both_triangles(pixels: DataFrame) -> DataFrame:
    """i, j, count of the whole matrix; the diagonal once. Only positive finite counts."""
    live = pixels.filter((F.col("count") > 0) & (F.col("count") < float("inf")) & ~F.isnan(F.col("count").cast("double")))
    upper = live.select(F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), "count")
    return upper.unionByName(live.filter("bin1_id <> bin2_id").select(F.col("bin2_id").alias("i"), F.col("bin1_id").alias("j"), "count"))


def row_sums(pixels: DataFrame) -> DataFrame:
    """bin_id, total and nonzeros of each row of the symmetric matrix."""
    return both_triangles(pixels).groupBy(F.col("i").alias("bin_id")).agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("nonzeros"))


def multiply(pixels: DataFrame, vector: DataFrame) -> DataFrame:
    """bin_id and value of the matrix times a vector (bin_id, w); bins without a value count 0."""
    return product(both_triangles(pixels), vector)


def product(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """As ``multiply``, of a matrix that has both triangles (i, j, count) already."""
    v = vector.select(F.col("bin_id").alias("j"), "w")
    return matrix.join(v, "j").groupBy(F.col("i").alias("bin_id")).agg(F.sum(F.col("count") * F.col("w")).alias("value"))


def balanced(pixels: DataFrame, weights: DataFrame) -> DataFrame:
    """Pixels of which both ends have a positive weight, with ``norm`` = count * w1 * w2."""
    live = weights.filter((F.col("w") > 0) & (F.col("w") < float("inf")))
    w1, w2 = live.select(F.col("bin_id").alias("bin1_id"), F.col("w").alias("_w1")), live.select(F.col("bin_id").alias("bin2_id"), F.col("w").alias("_w2"))
    return pixels.join(w1, "bin1_id").join(w2, "bin2_id").withColumn("norm", F.col("count") * F.col("_w1") * F.col("_w2")).drop("_w1", "_w2")


def keep_total(pixels: DataFrame, weights: DataFrame, group: DataFrame | None = None) -> DataFrame:
    """Weights scaled so that the balanced matrix keeps its raw total, off-diagonal pixels counting twice.

    ``group`` (bin_id, chrom_id) scales each chromosome by itself.
    """
    norm = balanced(pixels, weights).withColumn("_m", F.when(F.col("bin1_id") == F.col("bin2_id"), 1).otherwise(2))
    scale = F.sqrt(F.sum(F.col("count") * F.col("_m")) / F.sum(F.col("norm") * F.col("_m"))).alias("scale")
    if group is None:
        return weights.crossJoin(F.broadcast(norm.agg(scale))).select("bin_id", (F.col("w") * F.col("scale")).alias("w"))  # one row
    by = norm.join(group.select(F.col("bin_id").alias("bin1_id"), "chrom_id"), "bin1_id").groupBy("chrom_id").agg(scale)
    return weights.join(group, "bin_id").join(by, "chrom_id").select("bin_id", (F.col("w") * F.col("scale")).alias("w"))


def cis(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """Pixels within a chromosome; ``bins`` has bin_id and chrom_id."""
    c1, c2 = bins.select(F.col("bin_id").alias("bin1_id"), F.col("chrom_id").alias("_c1")), bins.select(F.col("bin_id").alias("bin2_id"), F.col("chrom_id").alias("_c2"))
    return pixels.join(c1, "bin1_id").join(c2, "bin2_id").filter("_c1 = _c2").drop("_c1", "_c2")


def vanilla(pixels: DataFrame, bins: DataFrame, square_root: bool = False) -> DataFrame:
    """VC or VC_SQRT weights: inverse coverage, or its root, within chromosomes, each keeping its total."""
    inner = cis(pixels, bins)
    cover = row_sums(inner)
    w = F.sqrt(1.0 / F.col("total")) if square_root else 1.0 / F.col("total")
    return keep_total(inner, cover.select("bin_id", w.alias("w")), bins.select("bin_id", "chrom_id"))


def ice_filter(cover: DataFrame, enough: int = 1000) -> DataFrame:
    """Bins that ICE takes: all, unless there are ``enough``; then those with 10 nonzeros and no outlying coverage."""
    stats = cover.agg(F.count(F.lit(1)).alias("n"), F.percentile(F.log("total"), F.lit(0.5)).alias("mid"))
    spread = cover.crossJoin(F.broadcast(stats)).agg(F.percentile(F.abs(F.log("total") - F.col("mid")), F.lit(0.5)).alias("mad"))
    judged = cover.crossJoin(F.broadcast(stats.crossJoin(spread)))  # one row of statistics
    return judged.filter((F.col("n") < enough) | ((F.col("nonzeros") >= 10) & (F.log("total") >= F.col("mid") - 5 * F.col("mad")))).select("bin_id")


def _positive_start(pixels: DataFrame) -> DataFrame:
    return row_sums(pixels).select("bin_id", F.lit(1.0).alias("w"))


def ice_step(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """One step over both triangles (i, j, count): w / sqrt(marginal / mean), and ``off``: marginal / mean - 1."""
    margin = product(matrix, weights).join(weights, "bin_id").select("bin_id", "w", (F.col("value") * F.col("w")).alias("m"))
    mean = margin.agg(F.avg("m").alias("mean"))
    rated = margin.crossJoin(F.broadcast(mean)).withColumn("rate", F.col("m") / F.col("mean"))  # one row
    return rated.select("bin_id", (F.col("w") / F.sqrt("rate")).alias("w"), (F.col("rate") - 1).alias("off"))


def ice(pixels: DataFrame, iterations: int = 200, tolerance: float = 1e-5, filter_bins: bool = True) -> DataFrame:
    """ICE weights that keep the matrix's total. Raises if the marginals don't settle."""
    weights, settled, _ = ice_stored(pixels, iterations, tolerance, filter_bins)
    if not settled:
        raise ValueError(f"marginals have not settled after {iterations} steps")
    return weights


def ice_stored(pixels: DataFrame, iterations: int = 200, tolerance: float = 1e-5, filter_bins: bool = True) -> tuple[DataFrame, bool, float | None]:
    """ICE weights as far as they come, whether the marginals have settled, and their last mean squared distance from the mean one."""
    cover = row_sums(pixels)
    active = ice_filter(cover) if filter_bins else cover.select("bin_id")
    ends = [active.select(F.col("bin_id").alias(c)) for c in ("bin1_id", "bin2_id")]
    inner = materialise(pixels.join(ends[0], "bin1_id", "left_semi").join(ends[1], "bin2_id", "left_semi").select("bin1_id", "bin2_id", "count"), "pixels")
    weights, matrix = _positive_start(inner), materialise(both_triangles(inner), "matrix")
    for _ in range(iterations):
        stepped = materialise(ice_step(matrix, weights), "ice")
        off = stepped.agg(F.avg(F.col("off") * F.col("off")).alias("v"), F.avg(F.log("w")).alias("g")).first()  # two numbers
        weights = stepped.select("bin_id", (F.col("w") / F.exp(F.lit(off["g"] or 0.0))).alias("w"))
        if off["v"] is None or off["v"] < tolerance:
            return keep_total(inner, weights), True, off["v"]
    return keep_total(inner, weights), False, off["v"]


def fused_scales(pixels: DataFrame, weights: DataFrame, whole: tuple[str, ...] = ("ICE", "KR"), cis_only: tuple[str, ...] = ("VC", "VC_SQRT")) -> DataFrame:
    """method, chrom_id and scale that keep the totals, of all methods from one scan of the pixels.

    ``weights`` has bin_id, chrom_id and a column for each method, null for bins left out. Methods of ``whole`` have one scale, with a null
    chromosome; those of ``cis_only`` one for each chromosome, from its own pixels. A scale is the root of raw over balanced total, of
    pixels of which both bins have a positive weight, off-diagonal ones twice; methods or chromosomes without such pixels have none.
    """
    methods = [*whole, *cis_only]
    side = lambda n: weights.select(F.col("bin_id").alias(f"bin{n}_id"), F.col("chrom_id").alias(f"_c{n}"), *[F.when((F.col(m) > 0) & (F.col(m) < float("inf")), F.col(m)).alias(f"_{m}{n}") for m in methods])
    met = pixels.join(side(1), "bin1_id").join(side(2), "bin2_id").withColumn("_m", F.col("count") * F.when(F.col("bin1_id") == F.col("bin2_id"), 1).otherwise(2))
    both = lambda m: F.col(f"_{m}1") * F.col(f"_{m}2")
    sums = [x for m in methods for x in (F.sum(F.when(both(m).isNotNull(), F.col("_m"))).alias(f"raw_{m}"), F.sum(F.col("_m") * both(m)).alias(f"norm_{m}"))]
    by = met.groupBy(F.when(F.col("_c1") == F.col("_c2"), F.col("_c1")).alias("chrom_id")).agg(*sums)  # a row for each chromosome, and one for what lies between them
    listed = by.select("chrom_id", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"raw_{m}").alias("raw"), F.col(f"norm_{m}").alias("norm")) for m in methods])).alias("x")).select("chrom_id", "x.*")
    grouped = listed.withColumn("chrom_id", F.when(F.col("method").isin(*cis_only), F.col("chrom_id"))).filter(F.col("method").isin(*whole) | F.col("chrom_id").isNotNull()).groupBy("method", "chrom_id").agg(F.sum("raw").alias("raw"), F.sum("norm").alias("norm"))
    return grouped.filter("norm > 0").select("method", "chrom_id", F.sqrt(F.col("raw") / F.col("norm")).alias("scale"))


def knight_ruiz(pixels: DataFrame, tolerance: float = 1e-6, products: int = 300) -> DataFrame:
    """Knight-Ruiz weights by the inner-outer Newton iteration, each product a Spark job over the pixels.

    Rows of the vectors live in DataFrames; only inner products reach the driver. Raises if ``products`` are used up.
    """
    p = materialise(pixels.select("bin1_id", "bin2_id", "count"), "pixels")
    x = materialise(row_sums(p).select("bin_id", (1.0 / F.sqrt("total")).alias("w")), "kr")
    used = 0

    def times(v: DataFrame) -> DataFrame:
        nonlocal used
        used += 1
        if used > products:
            raise ValueError(f"not balanced after {products} products")
        return multiply(p, v)

    eta, residual = 0.1, None
    while True:
        # v = x * (A x); r = 1 - v
        base = materialise(times(x).join(x, "bin_id").select("bin_id", "w", (F.col("value") * F.col("w")).alias("v"), (1 - F.col("value") * F.col("w")).alias("r")), "kr")
        rho = base.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
        if rho <= tolerance:
            break
        eta = 0.1 if residual is None else max(min(0.1, 0.9 * rho / residual), 0.5 * tolerance / rho)
        residual, goal = rho, max(eta * eta * rho, tolerance)
        state = base.select("bin_id", "w", "v", "r", F.lit(1.0).alias("y"), F.lit(0.0).alias("d"))
        old = None
        inner = rho
        while inner > goal:
            z = state.withColumn("z", F.col("r") / F.col("v"))
            rz = z.agg(F.sum(F.col("r") * F.col("z"))).first()[0]
            state = materialise(z.withColumn("d", F.col("z") + F.lit(0.0 if old is None else rz / old) * F.col("d")).drop("z"), "kr")
            old = rz
            product = times(state.select("bin_id", (F.col("w") * F.col("d")).alias("w")))
            state = materialise(state.join(product, "bin_id", "left").withColumn("q", F.col("w") * F.coalesce("value", F.lit(0.0)) + F.col("v") * F.col("d")).drop("value"), "kr")
            dq = state.agg(F.sum(F.col("d") * F.col("q"))).first()[0]
            alpha = rz / dq
            # the step stays between the bounds that keep the weights positive
            limits = state.agg(F.min(F.when(F.lit(alpha) * F.col("d") < 0, (0.1 - F.col("y")) / (F.lit(alpha) * F.col("d")))).alias("low"), F.min(F.when(F.lit(alpha) * F.col("d") > 0, (3.0 - F.col("y")) / (F.lit(alpha) * F.col("d")))).alias("high")).first()
            bound = min([1.0, *[b for b in limits if b is not None]])
            state = materialise(state.select("bin_id", "w", "v", (F.col("r") - F.lit(alpha) * F.col("q")).alias("r"), (F.col("y") + F.lit(alpha * bound) * F.col("d")).alias("y"), "d"), "kr")
            if bound < 1.0:
                break
            inner = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
        x = materialise(state.select("bin_id", (F.col("w") * F.col("y")).alias("w")), "kr")
    return keep_total(p, base.select("bin_id", "w"))


def stored_form(weights: DataFrame, divisive: bool) -> DataFrame:
    """Weights as a container stores them: divisive columns hold reciprocals, bins left out NaN."""
    fine = (F.col("w") > 0) & (F.col("w") < float("inf"))
    return weights.select("bin_id", F.when(fine, 1.0 / F.col("w") if divisive else F.col("w")).otherwise(float("nan")).alias("stored"))
