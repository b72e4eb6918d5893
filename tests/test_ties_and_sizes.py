import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.functions.sizes import small
from strandloom.operators import evidence, loci, pyramid
from strandloom.plans import views
from strandloom.sources import tiles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def islands(rows, gap):
    """start, end and members of the islands of sorted intervals."""
    out = []
    for start, end in sorted(rows):
        if out and start <= out[-1][1] + gap:
            out[-1][1], out[-1][2] = max(out[-1][1], end), out[-1][2] + 1
        else:
            out.append([start, end, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("name", ["q_ranges_merge", "q_clusters", "q_interval_union", "q_interval_intersection"])
def test_sql_of_islands_counts_equal_intervals_to_one(name):
    length, gap = 1_000_000_000, 2000 if name == "q_clusters" else 0
    with duckdb.connect() as con:
        con.execute("SET threads = 8; SET preserve_insertion_order = false")
        con.execute("CREATE TABLE part AS SELECT 1::BIGINT AS p_partkey, 1000000::INTEGER AS p_size, 'Brand#11' AS p_brand")
        con.execute("CREATE TABLE lineitem AS SELECT (hash(g) % 100000000)::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1 AS l_linenumber, (g % 2 * 40 + 5)::DOUBLE AS l_quantity FROM range(60000) t(g), range(3) u(r) ORDER BY hash(g * 7 + r)")
        rows = con.execute("SELECT l_orderkey * 131 % ?, least(l_orderkey * 131 % ? + 500, ?), l_quantity FROM lineitem", [length] * 3).fetchall()
        found = con.execute(entry.oracle_sql()[name]).fetchall()
    every = islands([r[:2] for r in rows], gap)
    if name == "q_interval_union":
        assert found == [(1, sum(e - s for s, e, _ in every))]
    elif name == "q_interval_intersection":
        a, b = (sum(e - s for s, e, _ in islands([r[:2] for r in rows if (r[2] >= 25) == high], 0)) for high in (True, False))
        assert found == [(1, a + b - sum(e - s for s, e, _ in every))]
    else:
        assert sorted(r[1:] for r in found) == every


def test_beyond_the_limit_nothing_is_broadcast(spark):
    left, right = spark.range(10), spark.range(10)
    assert "Broadcast" in plan(left.join(small(right, 10), "id"))
    assert "Broadcast" not in plan(left.join(small(right, 9), "id"))


def test_bins_are_not_broadcast_by_the_size_of_their_chromosomes(spark):
    chroms = spark.createDataFrame([(1, 9_000_000), (2, 500)], "chrom_id long, length long")
    bins = pyramid.bins(chroms, 1_000)
    met = spark.range(9_001).withColumnRenamed("id", "bin_id").join(bins.select("bin_id", (F.col("bin_id") % 7).alias("w")), "bin_id")
    assert "Broadcast" not in plan(met) and met.count() == 9_001


def test_end_windows_are_shuffled_and_a_pair_listed_twice_counts_once(spark):
    blocks = spark.createDataFrame([(1, 0, 40), (2, 40, 80), (3, 80, 90)], "block_id long, visual_start long, visual_end long")
    cells = spark.createDataFrame([(0, 4, 2.0), (3, 4, 4.0), (1, 8, 8.0)], "x_bin long, y_bin long, count double")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (3, 1), (2, 3)], "source long, target long")
    found = evidence.quadrants(cells, blocks, pairs, 10, 20)
    assert "BroadcastExchange" not in plan(found)
    # each window of blocks 1 and 2 has two whole bins; both windows of block 3 are its one bin
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 2.0, 0.0, 4.0, 0.0), (3, 1, 8.0, 0.0, 8.0, 0.0)]


def test_fingerprint_of_many_rows_fits(spark):
    n = 140_000
    found = spark.range(n).select(F.col("id").cast("string").alias("node"), F.lit("anchor").alias("status"), F.lit(1).cast("long").alias("target"), F.lit("+").alias("strand"), F.lit(1).cast("long").alias("blocks"))
    edges = spark.createDataFrame([], "a string, b string, kind string, confidence string")
    masks = spark.createDataFrame([], "a string, b string, reason string")
    row = loci.pruning_summary(found, edges, masks).first()
    assert row.anchors == n and row.fingerprint == sum(int(hashlib.md5(f"{k}|anchor|1|+".encode()).hexdigest()[:12], 16) for k in range(n)) % 1_000_000_007


@pytest.mark.parametrize("half", [False, True])
def test_dense_tiles_come_back_in_batches_and_not_tile_by_tile(spark, half, monkeypatch):
    monkeypatch.setattr(tiles, "HELD_CELLS", 16 * 5)
    cells = spark.range(300).select((F.col("id") * 3).alias("x_bin"), (F.col("id") * 5 % 97).alias("y_bin"), (F.col("id") - 2).cast("double").alias("count"))
    packed = tiles.dense_tiles(cells, 4, half).repartition(1)
    want = {(3 * k, 5 * k % 97): float(k - 2) for k in range(300) if k != 1}  # -1 stands for an empty cell
    assert {(r.x_bin, r.y_bin): r["count"] for r in tiles.dense_cells(packed, 4, half).collect()} == want


def test_lines_are_dealt_by_their_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "LINE_ROWS", 100)
    spark.range(5_000).selectExpr("id div 4 as l_orderkey", "1L as l_partkey", "1L as l_suppkey", "cast(id % 4 as int) as l_linenumber", "1D as l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    lines = views._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == 50
    assert lines.filter("k = l_linenumber + 1").count() == 5_000


def _plan(df, stage="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), stage)().toString()


def _placed(spark):
    from strandloom.operators import layout

    return layout.with_visual(spark.createDataFrame([(i, "o", i, 0, 70, "+", 10, i) for i in range(6)], "block_id long, object_id string, source_id long, source_start long, source_end long, orientation string, gap_before long, ord long"))


def test_pairs_of_links_meet_no_sizes_after_they_are_summed(spark):
    from strandloom.operators import evidence

    cells = spark.createDataFrame([(0, 3, 8.0), (1, 4, 4.0)], "x_bin long, y_bin long, count double")
    found = evidence.contact_links(cells, _placed(spark), 100)
    assert _plan(found).count("Join ") == 2  # a cell's two ends; before, also the sizes of both blocks
    assert all(r.normalized_per_mb2 == r.raw_count / (70 / 1e6 * (70 / 1e6)) for r in found.collect())


def test_pairs_of_links_are_summed_in_squares_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(evidence, "TILE_BINS", 2, raising=False)
    placed = _placed(spark).withColumn("visual_end", F.col("visual_end") + F.when(F.col("block_id") == 2, 170).otherwise(0))  # over three squares of 50 bases
    counts = {(x, y): float(1 + x * y % 7) for x in range(20) for y in range(x, 20)}
    found = evidence.contact_links(spark.createDataFrame([(x, y, c) for (x, y), c in counts.items()], "x_bin long, y_bin long, count double"), placed, 25)
    assert "hashpartitioning(source" not in _plan(found, "executedPlan") and "hashpartitioning(least" not in _plan(found, "executedPlan")
    bases = {(r.block_id, k): max(0, min(r.visual_end, 25 * k + 25) - max(r.visual_start, 25 * k)) for r in placed.collect() for k in range(20)}
    share = {(b, k): n / sum(m for (_, j), m in bases.items() if j == k) for (b, k), n in bases.items() if n}
    plain = {}
    for (x, y), c in counts.items():
        for a, b in ((a, b) for a in range(6) for b in range(6) if a != b and (a, x) in share and (b, y) in share):
            plain[min(a, b), max(a, b)] = plain.get((min(a, b), max(a, b)), 0.0) + c * share[a, x] * share[b, y]
    rows = found.collect()
    assert len(rows) == len(plain) and all(abs(plain[r.source, r.target] - r.raw_count) < 1e-9 for r in rows)


def test_links_of_a_selection_form_no_other_pairs(spark):
    from strandloom.operators import evidence, navigation

    cells = spark.createDataFrame([(x, y, 8.0) for x in range(5) for y in range(x, 5)], "x_bin long, y_bin long, count double")
    placed = _placed(spark)
    selected = placed.filter("block_id IN (1, 4)").union(placed.filter("block_id = 1"))
    found = navigation.selected_links(cells, placed, 100, selected)
    every = evidence.contact_links(cells, placed, 100).filter("(source IN (1, 4)) <> (target IN (1, 4))")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect()))
    assert "Aggregate" in _plan(found).split("Join ")[0] and _plan(found).count("Join ") == 2  # no join behind the sums


def test_arbitration_shuffles_thrice_and_joins_what_borders_of_cells_cut(spark):
    from strandloom.operators import synteny

    cell = synteny.CELL
    names = "aln_id long, query_name long, target_name long, strand string, query_start long, query_end long, target_start long, target_end long, matches long, block_len long, mapq int"
    rows = spark.createDataFrame([(1, 7, 1, "+", 5, 3 * cell, 0, 9, 80, 100, 8), (2, 7, 2, "-", cell, 2 * cell, 0, 9, 80, 100, 9), (3, 7, 3, "+", cell + 9, cell + 9, 0, 9, 80, 100, 60)], names)
    found = synteny.arbitrate(rows)
    assert sorted((r.start, r.end, r.aln_id) for r in found.collect()) == [(5, cell, 1), (cell, 2 * cell, 2), (2 * cell, 3 * cell, 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _plan(synteny.arbitrate(rows), "executedPlan").count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_consolidation_finds_its_chains_once_and_single_alignments_without_python(spark):
    from strandloom.operators import synteny

    names = "query_name long, target_name long, strand string, query_start long, query_end long, target_start long, target_end long, matches long, block_len long, mapq int"
    rows = [(1, 1, "-", 0, 50, 100, 160, 40, 50, 7), (2, 1, "+", 0, 50, 100, 160, 40, 50, 7), (2, 1, "+", 60, 90, 170, 200, 20, 30, 5), (3, 1, "+", 0, 5, 0, 5, 4, 5, 9)]
    assert "MapInArrow" not in _plan(synteny.consolidate(spark.createDataFrame(rows, names), 10))
    found = sorted(map(tuple, synteny.chains(spark.createDataFrame(rows, names), 10).collect()))
    assert found == [(1, 1, "-", 0, 50, 100, 160, 40, 50, 7, 1, 60), (2, 1, "+", 0, 90, 100, 200, 60, 80, 5, 2, 90)]


def test_delta_slices_come_from_one_scan(spark):
    from strandloom.plans import catalogue

    assert "Union" not in _plan(catalogue.QUERIES["q_delta_batch"](spark, "/root/testdata/sf0.001")).split("Aggregate")[1]


def test_loci_are_shuffled_once_and_their_alignments_without_numbers(spark):
    names = "node string, length long, target string, start double, end double, query_from long, query_to long, strand string, identity double, mapq int, bases long, primary boolean, locus long"
    rows = [("n", 100, "t", 0.0, 9.0, 0, 50, "+", 0.5, 60, 50, False, 1), ("n", 100, "t", 5.0, 9.0, 40, 70, "-", 1.0, 60, 30, False, 1), ("n", 100, "t", 6.0, 9.0, 45, 60, "+", 0.5, 60, 15, False, 1), ("n", 100, "u", 6.0, 9.0, 90, 95, "-", 0.5, 6, 5, True, 1)]
    found = loci.locus_table(spark.createDataFrame(rows, names))
    assert plan(found).count("Exchange") == 1
    assert {(r.target, r.coverage, r.strand, r.primary) for r in found.collect()} == {("t", 0.7, "+", False), ("u", 0.05, "-", True)}
    with_ids, without = (views.paf(spark, "/root/testdata/sf0.001", ids) for ids in (True, False))
    assert "RepartitionByExpression" not in _plan(without)
    assert sorted(map(tuple, with_ids.drop("aln_id").collect())) == sorted(map(tuple, without.collect()))


def test_a_map_is_made_once_to_be_thinned(spark):
    from strandloom.operators import navigation

    cells = spark.range(900).selectExpr("id div 3 as x_bin", "id div 2 as y_bin").groupBy("x_bin", "y_bin").agg(F.count("*").alias("count"))
    for most in (50, 5_000):
        assert "groupBy" not in (text := _plan(navigation.thinned(cells, most))) and "Aggregate" not in text


def dealt_and_whole(spark, monkeypatch, name):
    """Rows of a query as it stands; its plan, its rows and the rows of its largest task where few rows are broadcast or come to a task."""
    query, sf = entry.queries()[name], "/root/testdata/sf0.001"
    whole = sorted(map(tuple, query(spark, sf).collect()))
    monkeypatch.setattr("strandloom.functions.sizes.BROADCAST_ROWS", 100)
    monkeypatch.setattr("strandloom.functions.sizes.TASK_ROWS", 500, raising=False)
    found = query(spark, sf)
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    return whole, plan(found), sorted(map(tuple, found.collect())), most


def test_cells_of_windows_are_counted_before_a_broadcast_and_pairs_dealt(spark, monkeypatch):
    whole, text, found, most = dealt_and_whole(spark, monkeypatch, "q_window_index")
    assert found == whole and text.count("SortMergeJoin") == 2 and most < 800  # of some 4,400 pairs


@pytest.mark.parametrize("name", ["q_line_distribution", "q_line_bands", "q_line_modes"])
def test_modes_of_a_pair_come_to_one_task_of_bounded_rows(spark, monkeypatch, name):
    whole, text, found, most = dealt_and_whole(spark, monkeypatch, name)
    assert found == whole and text.count("SortMergeJoin") == 4 and most < 1_600  # of some 14,000 pairs and lines
    assert text.index("REPARTITION_BY_NUM") < text.index("SortMergeJoin") and "ENSURE_REQUIREMENTS" not in text[: text.index("SortMergeJoin")]
