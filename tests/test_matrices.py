import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import balance, graph, pyramid

PIXELS = [(0, 0, 4.0), (0, 1, 1.0), (0, 2, 2.0), (1, 1, 3.0), (1, 2, 1.0), (2, 2, 5.0)]


def pixels(spark, data=PIXELS):
    return spark.createDataFrame(data, "bin1_id long, bin2_id long, count double")


def total(df, column):
    return df.agg(F.sum(F.col(column) * F.when(F.col("bin1_id") == F.col("bin2_id"), 1).otherwise(2))).first()[0]


def test_coverage_weights_keep_the_total(spark):
    bins = spark.createDataFrame([(i, 0) for i in range(3)], "bin_id long, chrom_id int")
    for root in (False, True):
        weights = balance.vanilla(pixels(spark), bins, root)
        assert total(balance.balanced(pixels(spark), weights), "norm") == pytest.approx(total(pixels(spark), "count"), rel=1e-9)


@pytest.mark.parametrize("method", ["ice", "knight_ruiz"])
def test_marginals_are_even(spark, method):
    weights = getattr(balance, method)(pixels(spark))
    norm = balance.balanced(pixels(spark), weights).drop("count").withColumnRenamed("norm", "count")
    margins = [r.total for r in balance.row_sums(norm).collect()]
    assert max(margins) / min(margins) == pytest.approx(1, abs=5e-3)
    assert total(norm, "count") == pytest.approx(total(pixels(spark), "count"), rel=1e-8)


def test_star_has_no_balance(spark):
    with pytest.raises(ValueError):
        balance.ice(pixels(spark, [(0, i, 1.0) for i in range(1, 5)]), iterations=30)


def test_bins_restart_at_chromosomes(spark):
    chroms = spark.createDataFrame([(0, 5500), (1, 2000)], "chrom_id long, length long")
    assert [(r.start, r.end) for r in pyramid.bins(chroms, 5000).orderBy("bin_id").collect()] == [(0, 5000), (5000, 5500), (0, 2000)]


def test_coarsen(spark):
    data = [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0), (1, 2, 4.0), (2, 2, 5.0)]
    mapping = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "parent_id long, bin_id long")
    assert {tuple(r) for r in pyramid.coarsen(pixels(spark, data), mapping).collect()} == {(0, 0, 6.0), (0, 1, 4.0), (1, 1, 5.0)}


def test_level_plan():
    assert pyramid.plan_levels([1000, 2000, 5000, 10000], 1000) == [(2000, 1000), (5000, 1000), (10000, 5000)]
    with pytest.raises(ValueError):
        pyramid.plan_levels([2000, 2000], 1000)


def test_components_of_a_long_path_and_empty(spark):
    rng = random.Random(3)
    nodes = list(range(60))
    rng.shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:])) + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == {n: 0 for n in nodes} | {100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_products_match_numpy(spark):
    dense = np.zeros((3, 3))
    for i, j, c in PIXELS:
        dense[i, j] = dense[j, i] = c
    vector = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "bin_id long, w double")
    found = {r.bin_id: r.value for r in balance.multiply(pixels(spark), vector).collect()}
    assert [found[i] for i in range(3)] == pytest.approx(list(dense @ [1, 2, 3]))
