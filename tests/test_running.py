import pytest

from strandloom.functions import storage
from strandloom.functions.running import total_before


@pytest.mark.parametrize("window_rows", [0, 999, 1000])
def test_totals_before_follow_the_order_over_all_ranges(spark, window_rows):
    n = 1_000
    df = spark.range(n).selectExpr("id * 7 % 1000 AS k", "id * 7 % 1000 + 1 AS v")
    up = {r.k: r.t for r in total_before(df, "k", "v", "t", window_rows=window_rows).collect()}
    assert up == {k: k * (k + 1) // 2 for k in range(n)}
    down = {r.k: r.t for r in total_before(df, "k", "v", "t", descending=True, window_rows=window_rows).collect()}
    assert down == {k: n * (n + 1) // 2 - (k + 1) * (k + 2) // 2 for k in range(n)}


@pytest.mark.parametrize("window_rows", [0, 1000])
def test_totals_before_of_null_keys_and_empty_tables(spark, window_rows):
    df = spark.createDataFrame([(None, 5), (2, 3), (1, 4)], "k long, v long")
    assert {r.k: r.t for r in total_before(df, "k", "v", "t", window_rows=window_rows).collect()} == {None: 0, 1: 5, 2: 9}
    assert total_before(df.limit(0), "k", "v", "t", window_rows=window_rows).count() == 0


def test_a_step_leaves_what_it_keeps(spark):
    def tables():
        return len(storage._tables(spark))

    first = storage.materialise(spark.range(3), "first")
    before = tables()
    with storage.step_scratch(spark) as keep:
        inner = storage.materialise(spark.range(5), "inner")
        out = keep(inner.join(first, "id"), "out")
    assert tables() == before + 1 and out.count() == 3 and first.count() == 3
    with pytest.raises(ValueError, match="stop"), storage.step_scratch(spark):
        storage.materialise(spark.range(5), "inner")
        raise ValueError("stop")
    assert tables() == before + 2
