import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import intervals, stats
from strandloom.operators import evidence, synteny
from strandloom.sources import alignments, gfa, tiles


def brute_chain(rows):
    """All collinear subsets."""
    best = None
    for mask in range(1, 1 << len(rows)):
        chain = sorted(r for i, r in enumerate(rows) if mask >> i & 1)
        ok = all(a[1] - min(1000, (a[1] - a[0]) // 2) <= b[0] and a[3] - min(1000, (a[3] - a[2]) // 2) <= b[2] for a, b in zip(chain, chain[1:]))
        score = (sum(r[3] - r[2] for r in chain), sum(r[4] for r in chain), sum(r[5] for r in chain), sum(r[6] * r[5] for r in chain), -len(chain))
        if ok and (best is None or score > best):
            best = score
    return best


def test_chain_against_all_subsets():
    rng = random.Random(5)
    for _ in range(60):
        rows = []
        for _ in range(rng.randint(1, 8)):
            q, t, n = rng.randint(0, 20_000), rng.randint(0, 20_000), rng.randint(500, 6000)
            rows.append((q, q + n, t, t + n, rng.randint(1, n), n, rng.randint(0, 60)))
        chain = synteny._best_chain(rows)
        score = (sum(r[3] - r[2] for r in chain), sum(r[4] for r in chain), sum(r[5] for r in chain), sum(r[6] * r[5] for r in chain), -len(chain))
        assert score == brute_chain(rows)


def test_gap_merge_literal(spark):
    data = [(1, "contig-a", "mono1", "+", 0, 1000, 10_000, 11_000, 60), (1, "contig-a", "mono1", "+", 1100, 2000, 11_100, 12_000, 55)]
    blocks = spark.createDataFrame(data, "block_id long, query_name string, target_name string, strand string, visual_start long, visual_end long, target_start long, target_end long, mapq int")
    out = [tuple(r)[4:] for r in synteny.merge_gaps(blocks, 200, 200).collect()]
    assert out == [(0, 2000, 10_000, 12_000, 55, 2)]
    assert synteny.merge_gaps(blocks, 50, 200).count() == 2


def test_paf_reader(spark):
    good = "u1 100 0 90 + t1 200 5 95 80 90 60 tp:A:P cm:i:4 tp:A:S"
    lines = spark.createDataFrame([(good,), ("short row",), ("u2 100 0 90 ? t1 200 5 95 80 90 60",), ("u3 100 0 90 - t1 200 5 95 80 90 256",)], "value string")
    [row] = alignments.paf(lines, lenient=True).collect()
    assert (row.query_name, row.strand, row.mapq, row.alignment_type, row.tags["cm"]["value"]) == ("u1", "+", 60, "primary", "4")
    with pytest.raises(Exception, match="bad PAF row"):
        alignments.paf(lines).collect()


def test_bedgraph_reader(spark):
    lines = spark.createDataFrame([("# c",), ("track x",), ("a 0 10 1.5",), ("a 10 5 2",)], "value string")
    assert [tuple(r) for r in alignments.bedgraph(lines, lenient=True).collect()] == [("a", 0, 10, 1.5)]
    with pytest.raises(Exception, match="bad bedGraph row"):
        alignments.bedgraph(lines).collect()


def test_gfa_reader(spark):
    data = [(1, "S\ts1\t*\tLN:i:100\trd:i:7"), (2, "S\ts2\tACGT"), (3, "L\ts1\t+\ts2\t-\t10M\tL1:i:90"), (4, "A\ts1\t0\tread\tHG:A:m"), (5, "A\ts1\t0\tread\tHG:A:p")]
    lines = spark.createDataFrame(data, "line_no long, value string")
    segments = {r.name: r for r in gfa.segments(lines).collect()}
    assert (segments["s1"].length, segments["s1"].read_depth, segments["s1"].reads, segments["s1"].haplotype_counts) == (100, 7, 2, {"m": 1, "p": 1})
    assert (segments["s2"].length, segments["s2"].has_sequence, segments["s2"].reads) == (4, True, 0)
    assert [tuple(r) for r in gfa.links(lines).collect()] == [(3, "s1", "end", "s2", "end", "10M", 90)]


def test_tiles_round_trip(spark):
    cells = spark.createDataFrame([(1, 2, 3.0), (5, 9, 0.5), (4, 4, 1.0)], "x_bin long, y_bin long, count double")
    found = set()
    for r in tiles.encoded_tiles(cells, 4).collect():
        bins, [(tx, ty, x, y, count)] = tiles.decode(bytes(r.payload))
        found |= {(tx * bins + int(a), ty * bins + int(b), float(c)) for a, b, c in zip(x, y, count)}
    assert found == {(1, 2, 3.0), (5, 9, 0.5), (4, 4, 1.0)}
    with pytest.raises(ValueError):
        tiles.decode(b"CST2" + bytes(20))


def test_intervals_against_sets(spark):
    rng = random.Random(1)
    data = [(k, s, s + rng.randint(0, 12), side) for k in range(4) for side in (0, 1) for s in (rng.randint(0, 60) for _ in range(6))]
    df = spark.createDataFrame(data, "key long, start long, end long, side int")
    covered = lambda k, side: {x for a, s, e, d in data if a == k and d in side for x in range(s, e)}
    union = {r.key: r.span for r in intervals.union_span(df, ["key"]).collect()}
    assert union == {k: len(covered(k, (0, 1))) for k in range(4)}
    both = {r.key: r.span for r in intervals.intersection_span(df.filter("side = 0"), df.filter("side = 1"), ["key"]).collect()}
    assert both == {k: n for k in range(4) if (n := len(covered(k, (0,)) & covered(k, (1,))))}


def test_nearest_against_brute_force(spark):
    rng = random.Random(2)
    data = [(0, i, s, s + rng.randint(1, 9)) for i, s in enumerate(rng.sample(range(200), 30))]
    found = {(r.anchor, r.side): [] for r in []}
    for r in evidence.nearest(spark.createDataFrame(data, "target long, anchor long, start long, end long"), 3).collect():
        found.setdefault((r.anchor, r.side), []).append((r.gap, r.other))
    for _, a, s, e in data:
        after = sorted((t - e, b) for _, b, t, _ in data if t >= e)[:3]
        before = sorted((s - u, -b) for _, b, _, u in data if u <= s)[:3]
        assert sorted(found.get((a, "after"), [])) == sorted(after)
        assert sorted(found.get((a, "before"), [])) == sorted((g, -b) for g, b in before)


def test_percentiles_and_wilson(spark):
    values = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 9)], "v double")
    found = {r.percent: r.value for r in stats.legacy_percentile(values, "v", [0, 50, 75, 100]).collect()}
    assert found == {0.0: 1.0, 50.0: 2.0, 75.0: 6.0, 100.0: 9.0}
    low, high = evidence.wilson(F.lit(8), F.lit(10))
    row = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert (row.low, row.high) == pytest.approx((0.4902, 0.9433), abs=1e-4)
    assert np.isclose(spark.range(1).select(stats.intensity(F.lit(9), 0, 99, log=True)).first()[0], 0.5)
