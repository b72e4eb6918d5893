import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import levels
from strandloom.operators import balance, contacts, layout, recommend
from strandloom.sources import matrix
from tests.test_layout_and_contacts import block, placed


def test_pairing_against_all_permutations():
    rng = random.Random(1)
    for _ in range(120):
        rows, cols = rng.randint(1, 4), rng.randint(1, 4)
        scores = [[rng.choice([0.0, 0.0, rng.random() * 9]) for _ in range(cols)] for _ in range(rows)]
        best = max(sum(scores[i][j] for i, j in zip(range(rows), p) if j < cols) for p in itertools.permutations(range(max(rows, cols)), rows))
        found = recommend.best_pairing(scores)
        used = [j for j in found if j >= 0]
        assert len(used) == len(set(used)) and all(scores[i][j] > 0 for i, j in enumerate(found) if j >= 0)
        assert sum(scores[i][j] for i, j in enumerate(found) if j >= 0) == pytest.approx(best)
    assert recommend.best_pairing([]) == []


def test_pair_groups(spark):
    data = [(1, 1, 1, 5.0), (1, 1, 2, 4.0), (1, 2, 1, 4.0), (2, 9, 9, 1.0), (2, 8, 9, 3.0)]
    out = recommend.pair_groups(spark.createDataFrame(data, "group long, row long, column long, score double"))
    assert {tuple(r) for r in out.collect()} == {(1, 1, 2, 4.0), (1, 2, 1, 4.0), (2, 8, 9, 3.0)}


def test_linkage_clusters(spark):
    data = [(0, 1, 0, 100), (0, 2, 10, 100), (0, 3, 60, 200), (0, 4, 300, 400), (1, 5, 0, 10)]
    out = recommend.linkage_clusters(spark.createDataFrame(data, "target long, anchor long, start long, end long"))
    assert {r.anchor: r.cluster for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_junction_scores(spark):
    q = spark.createDataFrame([(1, 2, 7.0, 0.0, 0.0, 0.0), (1, 3, 1.0, 1.0, 1.0, 1.0)], "source long, target long, ll double, lr double, rl double, rr double")
    assert {r.target: (r.ends, r.score) for r in recommend.junction_scores(q).collect()} == {2: ("ll", 3.0), 3: ("ll", 0.0)}


def test_matrix_round_trip(spark, tmp_path):
    chroms = spark.createDataFrame([(0, 4000), (1, 3000)], "chrom_id long, length long")
    pixels = spark.createDataFrame([(0, 0, 4.0), (0, 1, 2.0), (1, 3, 6.0), (2, 5, 1.0), (4, 4, 8.0), (4, 6, 2.0)], "bin1_id long, bin2_id long, count double")
    matrix.generate(pixels, chroms, str(tmp_path), [1000, 2000], 1000)
    assert matrix.resolutions(spark, str(tmp_path)) == [2000, 1000]
    raw = {tuple(r) for r in matrix.contacts(spark, str(tmp_path), 2000).collect()}
    assert raw == {(0, 0, 0, 0, 6.0), (0, 0, 0, 2000, 6.0), (0, 2000, 1, 0, 1.0), (1, 0, 1, 0, 8.0), (1, 0, 1, 2000, 2.0)}
    one = spark.createDataFrame([(0, 0, 2000)], "source_id long, start long, end long")
    assert {tuple(r) for r in matrix.contacts(spark, str(tmp_path), 1000, ranges=one).collect()} == {(0, 0, 0, 0, 4.0), (0, 0, 0, 1000, 2.0)}
    bins = spark.read.parquet(str(tmp_path / "bins")).filter("resolution = 1000")
    weights = balance.vanilla(pixels, bins.select("bin_id", "chrom_id"))
    want = {(r.bin1_id, r.bin2_id): r.norm for r in balance.balanced(pixels, weights).collect()}
    stored = sorted(r["count"] for r in matrix.contacts(spark, str(tmp_path), 1000, "VC").collect())
    assert stored == pytest.approx(sorted(want.values()))
    assert [r.bin1_offset for r in bins.orderBy("bin_id").collect()] == [0, 2, 3, 4, 4, 6, 6]


def test_levels():
    assert levels.nearest_level(15, [10, 20]) == 20 and levels.level_at_least(11, [5, 10, 20]) == 20 and levels.level_at_least(99, [5, 10]) == 10
    assert levels.overview_resolution(320_001, 1000) == 2000 and levels.render_resolution(2_000_000, 2_000_000, 1000) == 2000
    assert levels.viewport_tiles((0, 600, 300, 601), 10, 10) == [(x, y) for x in range(7) for y in range(x, 7) if y >= 3 and (x < 6 or y > 6)]
    assert levels.parse_jump("ctg:1,001-2,000") == ("ctg", 1000, 2000) and levels.parse_jump(" ctg ") == ("ctg", None, None)
    with pytest.raises(ValueError):
        levels.parse_jump("c:5-4")


def test_edits(spark):
    data = [(1, "o", "a", 0, 10, "+", 0, 1), (2, "o", "b", 0, 10, "+", 5, 2), (3, "p", "c", 0, 10, "-", 0, 3)]
    base = spark.createDataFrame(data, "block_id long, object_id string, source_id string, source_start long, source_end long, orientation string, gap_before long, ord long")
    moved = [(r.block_id, r.object_id) for r in layout.move_before(base, [3], 2).orderBy("ord").collect()]
    assert moved == [(1, "o"), (3, "o"), (2, "o")]
    copied = layout.copy_blocks(base, base.filter("block_id = 1").select("block_id"), "debris")
    assert [(r.source_id, r.object_id) for r in copied.orderBy("ord").collect()][-1] == ("a", "debris")
    assert layout.delete_blocks(base, base.filter("block_id = 2").select("block_id")).count() == 2
    assert {r.object_id: r.blocks for r in recommend.layout_impact(base, layout.reverse(base, F.col("block_id") == 3)).collect()} == {"p": 1}


def test_coarse_level_equals_base_where_blocks_are_aligned(spark):
    whole = placed(spark, block(1, 0, 0, 4000, 0), block(2, 1, 0, 4000, 4000, "-"))
    base = spark.createDataFrame([(0, x, 1, y, float(x + y + 1000)) for x in range(0, 4000, 1000) for y in range(0, 4000, 1000)], "source1 long, start1 long, source2 long, start2 long, count double")
    fine = {tuple(r) for r in contacts.project(base, whole.withColumn("source_id", F.col("source_id").cast("long")), 2000).collect()}
    up = base.groupBy("source1", F.expr("start1 div 2000 * 2000").alias("start1"), "source2", F.expr("start2 div 2000 * 2000").alias("start2")).agg(F.sum("count").alias("count"))
    coarse = {tuple(r) for r in contacts.project(up, whole.withColumn("source_id", F.col("source_id").cast("long")), 2000).collect()}
    assert fine == coarse


def _layout(spark, data):
    return spark.createDataFrame(data, "block_id long, object_id string, source_id string, source_start long, source_end long, orientation string, gap_before long, ord long")


def test_more_edits(spark):
    base = _layout(spark, [(1, "o", "a", 0, 10, "+", 0, 1), (2, "o", "b", 0, 10, "+", 5, 2), (3, "p", "c", 0, 10, "-", 0, 3)])
    placed_in = layout.place_segment(base, F.lit("u"), 7, 2, 99).orderBy("ord").collect()
    assert [(r.source_id, r.gap_before) for r in placed_in] == [("a", 0), ("u", 5), ("b", 100), ("c", 0)]
    pairs = spark.createDataFrame([("p", "o")], "a string, b string")
    assert {r.object_id for r in layout.merge_objects(base, pairs).collect()} == {"o"}
    assert layout.same_blocks(base, layout.move_object_first(base, "p")).first()[0]
    assert not layout.same_blocks(base, base.filter("block_id > 1")).first()[0]
    cut = layout.split_at(layout.with_visual(base), F.lit(4), gap=0)
    assert [(r.source_id, r.source_start, r.source_end) for r in layout.join_split_runs(cut).orderBy("ord").collect()] == [("a", 0, 10), ("b", 0, 10), ("c", 0, 10)]


def test_tiered_partners(spark):
    links = spark.createDataFrame([(1, 2, 9), (1, 3, 5), (1, 4, 7)], "source long, target long, score long")
    chosen = spark.createDataFrame([(1,)], "selected long")
    conflicts = spark.createDataFrame([(1, 4)], "selected long, partner long")
    partners = recommend.tiered_partners(links, chosen, conflicts, 1)
    assert {(r.partner, r.tier) for r in partners.collect()} == {(2, 0), (4, 1)}


def test_linkage_clusters_against_a_plain_fold(spark):
    import random

    rng = random.Random(11)
    data = [(t, a, s := rng.randrange(0, 300), s + rng.randint(1, 60)) for t in range(3) for a in range(t * 100, t * 100 + 40)]
    want = []
    for target in range(3):
        clusters = []
        for _, a, s, e in sorted((r for r in data if r[0] == target), key=lambda r: (r[2], r[3], r[1])):
            fits = [min((min(e, me) - max(s, ms)) / max(1, min(e - s, me - ms)) for _, ms, me in c) for c in clusters]
            best = max((f for f in fits if f >= 0.5), default=None)
            if best is None:
                clusters.append([(a, s, e)])
            else:
                clusters[fits.index(best)].append((a, s, e))
        want += [(target, m[0], c[0][0]) for c in clusters for m in c]
    got = recommend.linkage_clusters(spark.createDataFrame(data, "target long, anchor long, start long, end long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
