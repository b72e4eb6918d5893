"""Clustered levels, adaptive maps, Knight-Ruiz, lines between alleles, trims and re-projection against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise
from strandloom.operators import adaptive, alleles, balance, contacts, knight_ruiz, layout, pyramid, reproject, trims
from strandloom.sources import matrix, ranged

CHROMS = [(1, 5000), (2, 900), (3, 12_000), (4, 3100)]
LAYOUT = "block_id long, object_id string, source_id long, source_start long, source_end long, orientation string, gap_before long, ord long"
BLOCKS = [
    (1, "a", 1, 0, 2500, "+", 0, 1), (2, "a", 3, 0, 7000, "-", 100, 2), (3, "a", 1, 2500, 5000, "-", 0, 3), (4, "b", 3, 7000, 12_000, "+", 300, 4), (5, "b", 2, 0, 900, "?", 100, 5), (6, "~c", 3, 2000, 4000, "+", 0, 6),
]


@pytest.fixture(scope="module")
def small_map(spark):
    chroms = spark.createDataFrame(CHROMS, "chrom_id long, length long")
    bins = pyramid.bins(chroms, 100)
    rng = random.Random(1)
    starts = [tuple(r) for r in bins.select("bin_id", "chrom_id", "start").orderBy("bin_id").collect()]
    counts = defaultdict(int)
    for _ in range(1500):
        i, j = sorted((rng.randrange(len(starts)), min(len(starts) - 1, int(rng.expovariate(0.05)))))
        counts[i, j] += rng.randint(1, 9)
    for j in range(40, len(starts)):
        counts[40, j] += 1
    pixels = spark.createDataFrame([(i, j, c) for (i, j), c in counts.items()], "bin1_id long, bin2_id long, count long")
    placed = layout.with_visual(spark.createDataFrame(BLOCKS, LAYOUT))
    rows = [(starts[i][1], starts[i][2], starts[j][1], starts[j][2], c) for (i, j), c in counts.items()]
    return chroms, bins, pixels, counts, placed, spark.createDataFrame(rows, "source1 long, start1 long, source2 long, start2 long, count long")


def test_rows_are_read_from_their_parts_alone(spark, small_map, tmp_path):
    _, bins, pixels, counts, _, _ = small_map
    path = str(tmp_path / "level")
    ranged.write_level(pixels, bins, path, 50)
    whole = spark.read.parquet(f"{path}/pixels")
    assert sorted((r.bin1_id, r.bin2_id, r.count_) for r in whole.withColumnRenamed("count", "count_").collect()) == sorted((i, j, c) for (i, j), c in counts.items())
    assert whole.filter("bin1_id = 40").select("part").distinct().count() > 2  # a large row is dealt over parts
    for first, last in [(38, 41), (209, 209)]:
        rows = spark.createDataFrame([(first, last)], "first long, last long")
        got = ranged.read_rows(spark, path, rows, 50)
        assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted((i, j, c) for (i, j), c in counts.items() if first <= i <= last)
        assert last == 209 or "PartitionFilters: [part#" in got._jdf.queryExecution().toString()
    # what isn't needed isn't opened: with the other parts' files damaged the same rows come back
    rows = spark.createDataFrame([(100, 110)], "first long, last long")
    needed = ranged.parts_of(ranged.pixel_ranges(rows, spark.read.parquet(f"{path}/rows")), 50)
    others = [f for f in (tmp_path / "level" / "pixels").glob("part=*/*.parquet") if int(f.parent.name[5:]) not in needed]
    assert len(others) > 20
    for f in others:
        f.write_bytes(b"damaged")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert sorted((r[0], r[1], r[2]) for r in ranged.read_rows(spark, path, rows, 50).collect()) == sorted((i, j, c) for (i, j), c in counts.items() if 100 <= i <= 110)
    with pytest.raises(ValueError, match="index"):
        ranged.read_rows(spark, path, spark.createDataFrame([(0, 100_000)], "first long, last long"), 50)
    assert ranged.read_rows(spark, path, spark.createDataFrame([], "first long, last long"), 50).count() == 0
    with pytest.raises(ValueError, match="positive"):
        ranged.write_level(pixels, bins, path, 0)


def test_a_view_reads_what_it_shows(spark, small_map, tmp_path):
    chroms, bins, pixels, _, placed, points = small_map
    path = str(tmp_path / "level")
    ranged.write_level(pixels, bins, path, 50)
    for view in [(0, 2500, 3000, 6000), (50_000, 60_000, 50_000, 60_000)]:
        pushed = contacts.project(ranged.read_view(spark, path, placed, chroms, 100, view, 50), placed, 500, view)
        whole = contacts.project(points, placed, 500, view)
        assert sorted(map(tuple, pushed.collect())) == sorted(map(tuple, whole.collect()))


def test_owners_of_pixels_and_problems_of_offsets(spark, small_map):
    _, bins, pixels, counts, _, _ = small_map
    index = ranged.row_index(pixels, bins)
    owners = {r.pixel: r.bin1_id for r in ranged.owner_rows(index, spark.range(len(counts) + 5).withColumnRenamed("id", "pixel"), 7).collect()}
    assert owners == dict(enumerate(sorted(i for i, _ in counts)))
    n, total = bins.count(), len(counts)
    good = [(r.bin_id, r.bin1_offset) for r in index.collect()] + [(n, total)]
    check = lambda rows: sorted(map(tuple, ranged.offset_problems(spark.createDataFrame(rows, "bin_id long, bin1_offset long"), n, total).collect()))
    assert check(good) == []
    assert check(good[:-1]) == [("length", n - 1)]
    assert ("start", 0) in check([(b, o + (b == 0)) for b, o in good])
    assert ("end", n) in check([(b, o - (b == n)) for b, o in good])
    assert check([x for x in good if x[0] != 50]) == [("gap", 51)]
    assert ("falls", 61) in check([(b, o + 400 * (b == 60)) for b, o in good])
    assert ("range", 1) in check([(b, -1 if b == 1 else o) for b, o in good])
    assert ("number", 7) in check([*good, (7, good[7][1])])
    assert check([]) == [("length", None)]


def test_adaptive_map_is_the_map_of_all_contacts(spark, small_map, tmp_path):
    chroms, _, pixels, counts, placed, points = small_map
    chain = [1000, 100]
    for r, level in pyramid.build_levels(pixels, chroms, sorted(chain), 100).items():
        ranged.write_level(level, pyramid.bins(chroms, r), f"{tmp_path}/{r}", 500)
    read = ranged.level_reader(spark, str(tmp_path), 500)
    cells, stats = adaptive.adaptive_map(read, chroms, placed, chain, 3000)
    assert sorted(map(tuple, cells.collect())) == sorted((r[0], r[1], float(r[2])) for r in contacts.project(points, placed, 3000).collect())
    assert [r for r, _, _ in stats] == chain and sum(n for _, n, _ in stats) < len(counts)
    view = (3000, 12_000, 3000, 12_000)
    part, _ = adaptive.adaptive_map(read, chroms, placed, chain, 300, view)
    assert sorted(map(tuple, part.collect())) == sorted((r[0], r[1], float(r[2])) for r in contacts.project(points, placed, 300, view).collect())


def test_adaptive_map_refuses_levels_that_do_not_nest(spark, small_map):
    chroms, _, pixels, _, placed, _ = small_map
    with pytest.raises(ValueError, match="levels"):
        adaptive.adaptive_map(lambda r, rows: pixels, chroms, placed, [500, 200], 500)
    wrong = spark.createDataFrame([(0, 1, 0, 600)], "bin_id long, chrom_id long, start long, end long")
    parents = spark.createDataFrame([(0, 1, 0, 500)], "bin_id long, chrom_id long, start long, end long")
    with pytest.raises(ValueError, match="reaches over"):
        adaptive.child_rows(parents.select("bin_id"), parents, wrong, 500)


# Knight-Ruiz


def pixels_of(spark, matrix):
    n = len(matrix)
    return spark.createDataFrame([(i, j, float(matrix[i][j])) for i in range(n) for j in range(i, n) if matrix[i][j]], "bin1_id long, bin2_id long, count double")


def marginals(pixels, weights):
    return {r.bin_id: r.value * r.w for r in balance.multiply(pixels, weights).join(weights, "bin_id").collect()}


def test_newton_makes_marginals_one(spark):
    rng = np.random.default_rng(3)
    full = rng.integers(20, 50, (8, 8))
    pixels = pixels_of(spark, full + full.T)
    weights, tried = knight_ruiz.knight_ruiz_ladder(pixels, rescale=False)
    assert tried == [{"percent": 0.0, "bins": 8, "failure": None}]
    assert sum((1 - m) ** 2 for m in marginals(pixels, weights).values()) <= 1e-11
    assert sum(marginals(pixels, balance.keep_total(pixels, weights)).values()) == pytest.approx(float((full + full.T).sum()))


def test_the_ladder_passes_over_equal_supports_and_drops_what_cannot_be_balanced(spark):
    rng = np.random.default_rng(4)
    full = rng.integers(5, 50, (12, 12))
    matrix = full + full.T
    matrix[11, :], matrix[:, 11] = 0, 0
    matrix[11, 0] = matrix[0, 11] = 1  # a leaf: its one neighbour has others
    pixels = pixels_of(spark, matrix)
    weights, tried = knight_ruiz.knight_ruiz_ladder(pixels, (0.0, 1.0, 2.0, 10.0), products=3)
    assert tried[0]["failure"] and tried[-1]["failure"] is None
    sizes = [t["bins"] for t in tried]
    assert sizes == sorted(set(sizes), reverse=True)  # percentiles 2, 3 and 4 leave what 1 does
    assert 11 not in {r.bin_id for r in weights.collect()}
    peeled, tried = knight_ruiz.knight_ruiz_ladder(pixels, peel=True)
    assert tried == [{"percent": 0.0, "bins": 11, "failure": None}]
    with pytest.raises(knight_ruiz.NotBalanced, match="products") as raised:
        knight_ruiz.knight_ruiz_ladder(pixels, (0.0,), last_products=2)
    active = raised.value.weights.select("bin_id")
    warm = knight_ruiz.warm_start(raised.value.weights, active.union(spark.createDataFrame([(99,)], "bin_id long")))
    assert np.mean([math.log(r.w) for r in warm.collect()]) == pytest.approx(0)
    assert knight_ruiz.knight_ruiz_ladder(pixels.limit(0)) [1] == []


def test_leaves_are_peeled_in_rounds(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (6, 7), (8, 8)]  # a triangle with a tail, a pair, a bin with itself
    pixels = spark.createDataFrame([(min(e), max(e), 1) for e in edges], "bin1_id long, bin2_id long, count long")
    kept = lambda rounds: sorted((r[0], r[1]) for r in knight_ruiz.peel_leaves(pixels, rounds).collect())
    assert kept(0) == sorted((min(e), max(e)) for e in edges)
    assert (4, 5) not in kept(1) and (3, 4) in kept(1)
    assert kept(16) == [(0, 1), (0, 2), (1, 2), (6, 7), (8, 8)]


def test_support_percentile_and_prebalance(spark):
    cover = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 0.0, float("nan"), float("inf")])], "bin_id long, total double")
    assert knight_ruiz.positive_percentile(cover, "total", 0) == 0
    assert knight_ruiz.positive_percentile(cover, "total", 50) == pytest.approx(2.5)
    pixels = spark.createDataFrame([(0, 1, 1), (1, 2, 5), (2, 3, 5), (3, 3, 2)], "bin1_id long, bin2_id long, count long")
    assert sorted(r[0] for r in knight_ruiz.active_support(pixels, balance.row_sums(pixels), 1.0).collect()) == [1, 2, 3]
    ones = spark.createDataFrame([(i, 1.0) for i in range(4)], "bin_id long, w double")
    before, after = (sum((1 - m) ** 2 for m in marginals(pixels, w).values()) for w in (ones, knight_ruiz.prebalance(pixels, ones, 6)))
    assert after < before / 10
    zero = spark.createDataFrame([(0, 0.0), (1, 1.0)], "bin_id long, w double")
    with pytest.raises(knight_ruiz.NotBalanced, match="marginal"):
        knight_ruiz.newton(pixels.filter("bin1_id = 0"), zero)
    assert knight_ruiz.stored_methods(1000) == ("VC", "VC_SQRT", "ICE") and "KR" in knight_ruiz.stored_methods(5000)


def test_siblings_are_planned_in_pairs_and_built_from_one_scan(spark, small_map):
    chroms, _, pixels, _, _, _ = small_map
    assert pyramid.plan_work([(400, 100), (600, 100), (700, 100), (1200, 600)]) == [(100, [400, 600]), (100, [700]), (600, [1200])]
    assert pyramid.plan_work([(500, 100), (700, 100), (1000, 100)]) == [(100, [500, 1000]), (100, [700])]
    one, other = (f(pixels, chroms, [100, 400, 600, 1200], 100) for f in (pyramid.build_levels, pyramid.build_paired_levels))
    for r in (400, 600, 1200):
        assert sorted(map(tuple, one[r].collect())) == sorted(map(tuple, other[r].collect()))


def test_all_scales_from_one_scan_are_those_of_each_method(spark):
    rng = np.random.default_rng(6)
    pixels = pixels_of(spark, np.triu(rng.integers(0, 9, (8, 8))))
    rows = [(i, i // 4, float(rng.random() + 0.1), None if i == 3 else float(rng.random() + 0.1), float(rng.random() + 0.1), 0.0 if i == 5 else float(rng.random() + 0.1)) for i in range(8)]
    weights = spark.createDataFrame(rows, "bin_id long, chrom_id long, ICE double, KR double, VC double, VC_SQRT double")
    found = {(r.method, r.chrom_id): r.scale for r in balance.fused_scales(pixels, weights).collect()}
    assert len(found) == 6
    for method in ("ICE", "KR"):
        own = weights.select("bin_id", F.col(method).alias("w")).filter("w > 0")
        first = own.join(balance.keep_total(pixels, own).withColumnRenamed("w", "v"), "bin_id").first()
        assert found[method, None] == pytest.approx(first.v / first.w)
    inner = balance.cis(pixels, weights.select("bin_id", "chrom_id"))
    for method in ("VC", "VC_SQRT"):
        own = weights.select("bin_id", F.col(method).alias("w")).filter("w > 0")
        for r in own.join(balance.keep_total(inner, own, weights.select("bin_id", "chrom_id")).withColumnRenamed("w", "v"), "bin_id").join(weights.select("bin_id", "chrom_id"), "bin_id").collect():
            assert found[method, r.chrom_id] == pytest.approx(r.v / r.w)
    with pytest.raises(ValueError, match="settled"):
        balance.ice(pixels, 1, filter_bins=False)
    last, settled, variance = balance.ice_stored(pixels, 1, filter_bins=False)
    assert not settled and variance > 1e-5 and last.count() == 8


# lines between alleles


def plain_pairs(cells, blocks, res, windows=50):
    """support, cells, covered and the best line of each pair, with its coverage, effective share and span."""
    members = defaultdict(list)
    for b in blocks:
        n = b["ve"] - b["vs"]
        if n >= 5 * res:
            for k in range(b["vs"] // res, (b["ve"] - 1) // res + 1):
                s, e = max(b["vs"], k * res), min(b["ve"], (k + 1) * res)
                mid = (s + e) / 2 - b["vs"]
                members[k].append((b, (e - s) / res, n - mid if b["o"] == "-" else mid))
    pairs = {}
    for x, y, c in cells:
        for bx, wx, ax in members[x]:
            for by, wy, ay in members[y]:
                if bx["id"] == by["id"] or bx["src"] == by["src"] or (x == y and bx["id"] >= by["id"]):
                    continue
                (l, la), (r, ra) = ((bx, ax), (by, ay)) if bx["id"] < by["id"] else ((by, ay), (bx, ax))
                ll, rl = l["ve"] - l["vs"], r["ve"] - r["vs"]
                resolved = max(1, min(windows, min(ll, rl) // res))
                w = max(1, min(ll, rl) // resolved)
                nl, nr = max(1, -(-ll // w)), max(1, -(-rl // w))
                pairs.setdefault((l["id"], r["id"]), {"nl": nl, "nr": nr, "rows": []})["rows"].append((c * wx * wy, min(int(la // w), nl - 1), min(int(ra // w), nr - 1), math.floor((ra - la) / w), math.floor((ra + la) / w)))
    out = {}
    for key, p in pairs.items():
        support = sum(r[0] for r in p["rows"])
        L, R = defaultdict(float), defaultdict(float)
        for w, l, r, _, _ in p["rows"]:
            L[l] += w
            R[r] += w
        best = None
        for line in "+-":
            seen = defaultdict(float)
            for w, _, _, plus, minus in p["rows"]:
                seen[plus if line == "+" else minus] += w
            for mode in range(1 - p["nl"], p["nr"]) if line == "+" else range(p["nl"] + p["nr"] - 1):
                observed = sum(seen.get(mode + o, 0) for o in (-1, 0, 1))
                expected = sum(w * R.get(l + mode + o if line == "+" else mode + o - l, 0) for l, w in L.items() for o in (-1, 0, 1)) / support
                z, rich = round((observed - expected) / math.sqrt(max(expected, 1)), 9), round(observed / max(expected, 1), 9)
                rank = (-z, -rich, -round(observed / support, 9), line, mode)
                if (z > 0 or z == 0 and rich > 0) and (best is None or rank < best[0]):
                    best = (rank, line, mode, observed, expected, z)
        near = [(w, l, r) for w, l, r, _, _ in p["rows"] if best and abs((r - l if best[1] == "+" else r + l) - best[2]) <= 1]

        def side(k, n, near=near):
            each = defaultdict(float)
            for row in near:
                each[row[k]] += row[0]
            total = sum(each.values())
            return (len(each) / n, total * total / sum(v * v for v in each.values()) / n, (max(each) - min(each) + 1) / n) if each else (0, 0, 0)

        spread = [min(a, b) for a, b in zip(side(1, p["nl"]), side(2, p["nr"]), strict=True)]
        out[key] = (support, len(p["rows"]), *(best[1:] if best else (None, None, 0, 0, 0)), *spread)
    return out


def allele_map(spark):
    rng = random.Random(8)
    blocks, at = [], 0
    for k, n in enumerate([5000, 4000, 700, 300, 6100, 900]):
        blocks.append({"id": k, "src": k // 2 if k > 3 else 10 + k, "vs": at, "ve": at + n, "o": "+-"[k % 2], "obj": f"o{k // 3}"})
        at += n + rng.choice([0, 50, 170])
    counts = defaultdict(int)
    for _ in range(900):
        x, y = sorted((rng.randrange(at) // 100, rng.randrange(at) // 100))
        counts[x, y] += rng.randint(1, 3)
    a, b = blocks[0], blocks[1]
    for k in range(0, 4000, 100):  # an allele: a runs backwards along b
        x, y = (a["vs"] + k) // 100, (b["ve"] - 1 - k) // 100
        counts[min(x, y), max(x, y)] += 12
    cells = [(x, y, float(c)) for (x, y), c in counts.items()]
    rows = [(b["id"], b["obj"], b["src"], 0, b["ve"] - b["vs"], b["o"], 0, b["id"], b["vs"], b["ve"]) for b in blocks]
    return cells, blocks, spark.createDataFrame(cells, "x_bin long, y_bin long, count double"), spark.createDataFrame(rows, LAYOUT + ", visual_start long, visual_end long")


def test_allele_pairs_against_a_plain_version(spark):
    cells, blocks, frame, placed = allele_map(spark)
    every = {"concordance": -1.0, "support": 0.0, "cells": 0, "covered": 0, "covered_share": 0.0}
    found = {(r.left, r.right): r for r in alleles.allele_pairs(frame, placed, 100, every).collect()}
    plain = plain_pairs(cells, blocks, 100)
    assert set(found) == set(plain)
    for key, (support, n, line, mode, observed, expected, z, coverage, effective, span) in plain.items():
        r = found[key]
        assert (r.cells, r.line, r.mode) == (n, line, mode)
        assert (r.support, r.observed, r.expected, r.z, r.coverage, r.effective, r.span) == pytest.approx((support, observed, expected, z, coverage, effective, span), abs=1e-6)
    strict = {(r.left, r.right): r for r in alleles.allele_pairs(frame, placed, 100).collect()}
    assert strict[0, 1].tier == "high" and strict[0, 1].direction == "+"  # both orders are turned: b shows its end first
    assert all(r.concordance > 0.2 or r.model == "trans-line" for r in strict.values())
    assert {k for k, r in strict.items() if r.direction == "+"} >= {(r.left, r.right) for r in alleles.allele_pairs(frame, placed, 100, line="+").collect()}
    assert alleles.allele_pairs(frame.limit(0), placed, 100).count() == 0
    assert all((r.left < 3) != (r.right < 3) for r in alleles.allele_pairs(frame, placed, 100, every, across_objects=True).collect())


def test_lines_of_objects_and_what_they_bring_together(spark):
    n, res = 30, 100
    rows = [(k, "a" if k < 10 else "b" if k < 20 else "c", 100 + k, 0, 300, "+", 0, k, k * 300, k * 300 + 300) for k in range(n)]
    placed = spark.createDataFrame(rows, LAYOUT + ", visual_start long, visual_end long")
    rng = random.Random(2)
    counts = defaultdict(float)
    for k in range(30):  # b runs backwards along a
        counts[k, 59 - k] += 40
    for _ in range(600):
        x, y = sorted((rng.randrange(90), rng.randrange(90)))
        counts[x, y] += 1
    frame = spark.createDataFrame([(x, y, c) for (x, y), c in counts.items()], "x_bin long, y_bin long, count double")
    lines = alleles.object_lines(frame, placed, res)
    [line] = lines.collect()
    assert (line.left, line.right, line.line, line.mode, line.windows) == ("a", "b", "-", 29, 30)
    inner = {(x, y - 30): c for (x, y), c in counts.items() if x < 30 <= y < 60}
    assert line.support == pytest.approx(sum(inner.values()))
    on = [c for (x, y), c in inner.items() if x + y == 29]
    assert (line.ratio, line.effective) == pytest.approx((sum(on) / line.support, sum(on) ** 2 / sum(c * c for c in on)))
    assert line.excess == pytest.approx(line.ratio - 30 / 900)
    found = sorted((r.block, r.partner, round(r.overlap, 6), round(r.distance, 6)) for r in alleles.line_partners(lines, placed, placed.filter("block_id IN (2, 17, 25)")).collect())
    plain = []
    for block in (2, 17):
        k = block % 10
        low, high = 29 - (3 * k + 3) - 1, 29 - 3 * k + 1
        for other in range(10):
            overlap = min(high, 3 * other + 3) - max(low, 3 * other)
            if overlap > 0:
                plain.append((block, other + (10 if block < 10 else 0), overlap, abs(3 * other + 1.5 - (low + high) / 2)))
    assert found == sorted(plain)


# trims


def test_overlaps_of_matches_alone(spark):
    rows = [("12M", 12), ("5M3=", 8), ("*", None), ("5M1I", None), ("", None), (None, None), ("M", None), ("3M ", None), ("007=", 7)]
    out = spark.createDataFrame([(c,) for c, _ in rows], "c string").select("c", trims.exact_overlap(F.col("c")).alias("n"))
    assert [(r.c, r.n) for r in out.collect()] == rows


LINK = "line_no long, from_segment long, from_side string, to_segment long, to_side string, overlap string, verified boolean"


KINDS = [
    ([], "++", None, 0), ([(1, 10, "end", 20, "start", "40M", False)], "++", None, 40), ([(1, 20, "start", 10, "end", "40M", False)], "++", None, 40), ([(1, 10, "end", 20, "end", "30=", False)], "+-", None, 30), ([(1, 10, "start", 20, "start", "30=", False)], "-+", None, 30),
    ([(1, 10, "start", 20, "start", "40M", False)], "++", "orientation-conflict", 0), ([(1, 10, "end", 20, "start", "*", False)], "++", "overlap-not-exact", None), ([(1, 10, "end", 20, "start", "500M", False)], "++", "overlap-too-long", 500), ([(1, 10, "end", 20, "start", "5M", False)], "+?", "orientation-unknown", 5),
    ([(1, 10, "end", 20, "start", "5M", True), (2, 20, "start", 10, "end", "7M", True)], "++", None, 7), ([(1, 10, "end", 20, "start", "5M", True), (2, 20, "start", 10, "end", "7M", False)], "++", "several-overlaps", 0), ([(1, 10, "end", 20, "start", "5M", True), (2, 10, "end", 20, "start", "7M", True)], "++", "several-overlaps", 0),
]


def test_every_kind_of_join(spark):
    """Each kind stands in an object of its own, of two sources of its own, and a third block that isn't selected."""
    rows, links, groups = [], [], []
    for k, (own, turn, _, _) in enumerate(KINDS):
        rows += [(10 * k + 1, f"o{k}", 100 * k + 10, 0, 1000, turn[0], 0, 1), (10 * k + 2, f"o{k}", 100 * k + 20, 0, 500, turn[1], 100, 2), (10 * k + 3, f"o{k}", 100 * k + 30, 0, 700, "+", 50, 3)]
        links += [(10 * k + n, 100 * k + f, fs, 100 * k + t, ts, c, v) for n, f, fs, t, ts, c, v in own]
        groups += [(10 * k + 1, f"g{k}"), (10 * k + 2, f"g{k}")]
    base, graph, selected = spark.createDataFrame(rows, LAYOUT), spark.createDataFrame(links, LINK), spark.createDataFrame(groups, "block_id long, group string")
    plan = {r.group: r for r in trims.plan_blocks(base, graph, selected).collect()}
    edited, ledger = trims.create_blocks(base, graph, selected)
    after, trimmed = {r.block_id: r for r in edited.collect()}, {r.block_id: r for r in ledger.collect()}
    for k, (_, turn, reason, trim) in enumerate(KINDS):
        assert (plan[f"g{k}"].reason, plan[f"g{k}"].trim, plan[f"g{k}"].done) == (reason, trim, reason is None)
        right, entry = after[10 * k + 2], trimmed.get(10 * k + 2)
        if reason is None:
            cut = (0, 500 - trim) if turn[1] == "-" else (trim, 500)
            assert (right.source_start, right.source_end, right.gap_before, right.assembly_block) == (*cut, 0, f"g{k}")
            assert (entry and (entry.trimmed, entry.original_start, entry.original_end)) == ((trim, 0, 500) if trim else None)
        else:
            assert tuple(right)[:8] == rows[3 * k + 1] and right.assembly_block is None and entry is None
        assert tuple(after[10 * k + 3])[:8] == rows[3 * k + 2]


def test_a_group_is_joined_as_a_whole_or_not_and_parted_again(spark):
    rows = [(k, "o" if k < 8 else "p", 10 * k, 0, 1000 + k, "+-"[k % 2], 100, k) for k in range(1, 12)]
    base = spark.createDataFrame(rows, LAYOUT)
    side = lambda k, shown: ("end" if shown == "left" else "start") if k % 2 else ("start" if shown == "left" else "end")
    links = [(k, 10 * k, side(k, "right"), 10 * k + 10, side(k + 1, "left"), "*" if k == 5 else f"{k}M", False) for k in range(1, 11)]
    group = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "y"), (6, "y"), (9, "z"), (11, "z")], "block_id long, group string")
    edited, ledger = (materialise(x, "edited") for x in trims.create_blocks(base, spark.createDataFrame(links, LINK), group))
    assert sorted((r.block_id, r.trimmed) for r in ledger.collect()) == [(2, 1), (3, 2)]  # y has an unclear overlap, z isn't one run
    units = {r.block_id: r.assembly_block for r in edited.collect()}
    assert {k for k, u in units.items() if u} == {1, 2, 3}
    wider = spark.createDataFrame([(k, "w") for k in (1, 2, 3, 4)], "block_id long, group string")
    more, grown = (materialise(x, "grown") for x in trims.create_blocks(edited, spark.createDataFrame(links, LINK), wider, ledger))
    assert sorted((r.block_id, r.trimmed) for r in grown.collect()) == [(2, 1), (3, 2), (4, 3)]  # what is joined isn't trimmed twice
    parted, left = trims.dissolve_blocks(more, grown, spark.createDataFrame([(3,)], "block_id long"))
    assert sorted(tuple(r)[:8] for r in parted.collect()) == rows and left.count() == 0
    assert all(r.assembly_block is None for r in parted.collect())


def test_deleted_gaps_restore_parts_and_trim_others(spark):
    rows = [(1, "o", 10, 0, 400, "+", 0, 1), (2, "o", 10, 400, 1000, "+", 100, 2), (3, "o", 20, 0, 500, "+", 100, 3), (4, "o", 30, 300, 900, "-", 0, 4), (5, "o", 30, 0, 300, "-", 70, 5), (6, "p", 40, 0, 50, "+", 10, 6)]
    links = spark.createDataFrame([(1, 10, "end", 20, "start", "25M", False), (2, 10, "end", 10, "start", "9M", False)], LINK)
    group = spark.createDataFrame([(k, "g") for k in range(1, 7)], "block_id long, group string")
    edited, ledger = trims.delete_gaps(spark.createDataFrame(rows, LAYOUT), links, group)
    assert sorted(tuple(r) for r in edited.collect()) == [(1, "o", 10, 0, 1000, "+", 0, 1), (3, "o", 20, 25, 500, "+", 0, 3), (4, "o", 30, 0, 900, "-", 0, 4), (6, "p", 40, 0, 50, "+", 10, 6)]
    assert [(r.block_id, r.trimmed) for r in ledger.collect()] == [(3, 25)]
    bad = links.union(spark.createDataFrame([(3, 10, "end", 20, "start", "1M", False)], LINK))
    same, none = trims.delete_gaps(spark.createDataFrame(rows, LAYOUT), bad, group)
    assert sorted(tuple(r) for r in same.collect()) == rows and none.count() == 0


# re-projection


def test_reprojected_cells_are_those_of_the_contacts_where_blocks_meet_bins(spark):
    rows = [(k, "ab"[k % 2], k, 0, 1000 * (k + 1), "+-"[k % 2], 1000 * (k % 3), k) for k in range(8)]
    before = layout.with_visual(spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[7])), LAYOUT))
    turned = layout.reverse(before, F.col("source_id") % 3 < 2)
    after = layout.with_visual(turned)
    rng = random.Random(5)
    points = []
    for _ in range(400):
        a, b = rng.randrange(8), rng.randrange(8)
        points.append((a, rng.randrange(1000 * (a + 1)), b, rng.randrange(1000 * (b + 1)), rng.randint(1, 5)))
    frame = spark.createDataFrame(points, "source1 long, start1 long, source2 long, start2 long, count long")
    moved = reproject.reproject(contacts.project(frame, before, 500), before, after, 500)
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, contacts.project(frame, after, 500).collect()))
    with pytest.raises(ValueError, match="same blocks"):
        reproject.reproject(moved, before, after.filter("block_id <> 3"), 500)


def test_a_container_is_checked_and_tells_what_has_settled(spark, tmp_path):
    chroms = spark.createDataFrame([(1, 1000), (2, 450)], "chrom_id long, length long")
    good = [(0, 0, 4), (0, 1, 3), (1, 2, 5), (3, 12, 2), (10, 14, 7), (2, 2, 1), (3, 3, 9)]
    frame = lambda rows: spark.createDataFrame(rows, "bin1_id long, bin2_id long, count long")
    path = str(tmp_path / "m")
    matrix.generate(frame(good), chroms, path, [100, 500], 100, ("VC", "KR"), kr_least=501)
    assert {tuple(r)[:3] for r in spark.read.parquet(f"{path}/states").collect()} == {(100, "VC", True), (500, "VC", True)}
    assert sorted(map(tuple, matrix.sequences(spark, path).collect())) == [(1, 1000), (2, 450)]
    bins = spark.read.parquet(f"{path}/bins/resolution=500")
    assert matrix.inferred_resolution(bins) == 500 and matrix.inferred_resolution(bins.limit(0)) is None
    for wrong, why in [((4, 2, 1), "lower triangle"), ((0, 99, 1), "outside"), ((5, 6, 0), "not positive"), ((0, 1, 3), "repeated"), ((None, 1, 3), "null")]:
        with pytest.raises(ValueError, match=why):
            matrix.generate(frame([*good, wrong]), chroms, path, [100], 100)


def test_contacts_of_windows_of_any_length(spark):
    windows = [(1, 10, 0, 7), (1, 11, 5, 40), (2, 20, 3, 4), (2, 21, 4, 4)]
    points = [(1, 6, 2, 3, 5), (2, 3, 1, 39, 2), (1, 0, 1, 6, 1), (1, 40, 2, 3, 9), (2, 4, 1, 0, 9)]
    want = defaultdict(int)
    for a, x, b, y, n in points:
        for s, w, lo, hi in windows:
            for r, v, low, high in windows:
                if s == a and lo <= x < hi and r == b and low <= y < high:
                    want[min(w, v), max(w, v)] += n
    for cell in (1000, 4):
        out = contacts.window_pairs(spark.createDataFrame(points, "source1 long, start1 long, source2 long, start2 long, count long"), spark.createDataFrame(windows, "source_id long, window long, start long, `end` long"), cell)
        assert {(r.w1, r.w2): r["count"] for r in out.collect()} == want
