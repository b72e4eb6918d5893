"""Loci as interval sets, and places on a map: literal cases and plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise
from strandloom.operators import layout, loci, navigation, recommend
from strandloom.sources import tiles

LAYOUT = "block_id long, object_id string, source_id long, source_start long, source_end long, orientation string, gap_before long, ord long"
PAF = "query_name long, query_start long, query_end long, target_name string, target_start long, target_end long, strand string, matches long, block_len long, mapq long"
INTERVALS = "node string, target string, start double, end double"


def blocks(spark):
    rows = [
        (1, "a", 1, 0, 1000, "+", 0, 1), (2, "a", 2, 0, 1000, "+", 0, 2), (3, "b", 3, 0, 1000, "+", 0, 3), (4, "b", 1, 0, 1000, "-", 0, 4), (5, "c", 4, 0, 600, "+", 0, 5), (6, "c", 4, 500, 1000, "+", 0, 6), (7, "c", 5, 0, 1000, "+", 0, 7), (8, "c", 6, 0, 1000, "+", 0, 8), (9, "c", 7, 0, 1000, "+", 0, 9),
    ]
    return spark.createDataFrame(rows, LAYOUT)


def test_anchors_and_why_not(spark):
    paf = [
        (1, 0, 900, "t", 100, 1000, "+", 900, 900, 60), (1, 900, 1000, "t", 500_000, 500_100, "+", 100, 100, 60),  # one locus holds nine tenths
        (2, 0, 500, "t", 0, 500, "-", 500, 500, 60), (2, 500, 1000, "u", 0, 500, "+", 500, 500, 60),  # two halves
        (3, 0, 800, "t", 0, 800, "+", 800, 800, 60), (3, 100, 900, "u", 0, 800, "+", 800, 800, 60),  # twice the same
        (4, 0, 1000, "t", 0, 1000, "+", 1000, 1000, 60),  # two nodes overlap on source 4
        (5, 0, 300, "t", 0, 300, "+", 300, 300, 60), (6, 0, 1000, "t", 0, 1000, "+", 500, 1000, 60), (7, 0, 1000, "t", 2000, 4000, "-", 1000, 1000, 0), (7, 0, 0, "t", 0, 9, "+", 1, 0, 60),
    ]
    nodes = loci.source_nodes(blocks(spark))
    seen = materialise(loci.clustered(loci.observations(nodes, spark.createDataFrame(paf, PAF)), 1000), "seen")
    found = materialise(loci.anchors(seen, loci.locus_table(seen), nodes), "found")
    status = {r.node: (r.status, r.blocks) for r in found.collect()}
    assert status == {
        "1:0-1000": ("anchor", 2), "2:0-1000": ("multi-locus-split", 1), "3:0-1000": ("multi-locus-repetitive", 1), "4:0-600": ("partial-source-overlap", 1), "4:500-1000": ("partial-source-overlap", 1),
        "5:0-1000": ("low-query-coverage", 1), "6:0-1000": ("low-identity", 1), "7:0-1000": ("low-mapq", 1),
    }
    best = found.filter("node = '1:0-1000'").first()
    assert (best.target, best.strand, best.coverage, best.dominance) == ("t", "+", 0.9, 0.9)
    assert [tuple(r) for r in loci.anchor_intervals(seen, found).collect()] == [("1:0-1000", "t", 100.0, 1000.0)]
    none = loci.anchors(seen.limit(0), loci.locus_table(seen.limit(0)), nodes)
    assert {r.status for r in none.collect()} == {"no-paf-alignment"}


def test_parts_of_an_alignment_are_projected_in_proportion(spark):
    row = spark.createDataFrame([(0, 100, 1000, 1250, s) for s in "+-"] + [(5, 5, 0, 9, "+")], "query_start long, query_end long, target_start long, target_end long, strand string")
    got = row.select(*loci.target_interval(F.lit(10), F.lit(30))).collect()
    assert [tuple(r) for r in got] == [(1025.0, 1075.0), (1175.0, 1225.0), (None, None)]


def test_gaps_within_anchors_share_nothing(spark):
    sets = {"a": [(0, 100), (300, 400)], "b": [(100, 300)], "c": [(0, 100), (310, 400)], "d": [(390, 900)], "e": [(380, 420)], "f": [(350, 352), (380, 382), (700, 702)]}
    frame = spark.createDataFrame([(k, "t", float(s), float(e)) for k, v in sets.items() for s, e in v] + [("z", "u", 0.0, 100.0)], INTERVALS)
    for cell in (1000, 37):
        found = {(r.a, r.b): (r.overlap, round(r.shorter, 6), round(r.reciprocal, 6), r.kind, r.confidence) for r in loci.allele_edges(frame, cell=cell).collect()}
        assert ("a", "b") not in found  # b only fills a's gap
        assert found["a", "c"] == (190.0, 1.0, 0.95, "allele", "high")
        assert found["d", "e"] == (30.0, 0.75, round(30 / 510, 6), "boundary-overlap", "high")
        assert found["a", "f"] == (4.0, round(4 / 6, 6), 0.02, "boundary-overlap", "high")
        assert found["a", "e"] == (20.0, 0.5, 0.1, "boundary-overlap", "high")


def test_edges_against_all_pairs(spark):
    rng = random.Random(3)
    sets = {f"n{k:02d}": sorted({(s := rng.randrange(0, 400), s + rng.randrange(1, 60)) for _ in range(3)}) for k in range(25)}
    rows, points = [], {}
    for name, spans in sets.items():
        covered = sorted({p for s, e in spans for p in range(s, e)})
        points[name] = set(covered)
        cuts = [i for i in range(1, len(covered)) if covered[i] != covered[i - 1] + 1]
        for part in np.split(np.array(covered), cuts):
            rows.append((name, "t", float(part[0]), float(part[-1] + 1)))
    plain = {}
    for a in sets:
        for b in sets:
            both = len(points[a] & points[b])
            if a < b and both and both / min(len(points[a]), len(points[b])) >= 0.5:
                plain[a, b] = (float(both), round(both / max(len(points[a]), len(points[b])), 6))
    found = {(r.a, r.b): (r.overlap, round(r.reciprocal, 6)) for r in loci.allele_edges(spark.createDataFrame(rows, INTERVALS), cell=50).collect()}
    assert found == plain


def test_equal_scores_are_equal_whatever_their_sums_say(spark):
    # two parts give 488.99999999999994 in place of 489: the locus of the greater coverage counts, and its half of all scores is a half
    paf = [(2, 0, 500, "t", 0, 500, "+", 405, 500, 60), (2, 500, 600, "t", 500, 600, "+", 84, 100, 60), (2, 0, 489, "s", 0, 489, "+", 489, 489, 60)]
    nodes = loci.source_nodes(blocks(spark))
    seen = materialise(loci.clustered(loci.observations(nodes, spark.createDataFrame(paf, PAF)), 1000), "seen")
    found = loci.anchors(seen, loci.locus_table(seen), nodes, {"dominance": 0.5}).filter("node = '2:0-1000'").first()
    assert (found.target, found.status) == ("t", "anchor")


def test_what_occupies_an_object(spark):
    base = blocks(spark)
    chosen = spark.createDataFrame([(1, "g"), (2, "g"), (7, "h")], "block_id long, group string")
    pairs = spark.createDataFrame([(2, 3), (1, 8), (1, 2), (9, 2)], "left long, right long")
    # node 2 is half covered by source 6's intervals together, node 5 is not covered by 7's gap
    intervals = spark.createDataFrame([("2:0-1000", "t", 0.0, 100.0), ("2:0-1000", "t", 200.0, 300.0), ("6:0-1000", "t", 0.0, 60.0), ("6:0-1000", "t", 100.0, 240.0), ("5:0-1000", "u", 0.0, 100.0), ("7:0-1000", "u", 90.0, 200.0), ("3:0-1000", "t", 0.0, 300.0)], INTERVALS)
    found = sorted((r.group, r.object_id, r.kind, r.locus, r.coverage) for r in loci.occupied_loci(base, chosen, pairs, intervals).filter("kind <> 'contact-pair'").collect())
    assert found == [("g", "b", "exact-source", "1:0-1000", 1.0), ("g", "c", "paf-locus", "t", 0.5)]  # b is taken by a copy of source 1 already
    contact = sorted((r.group, r.object_id, r.locus) for r in loci.occupied_loci(base, chosen, pairs, intervals).filter("kind = 'contact-pair'").collect())
    assert contact == [("g", "c", "1-8"), ("g", "c", "2-9")]


def test_masks_and_a_fingerprint_without_order(spark):
    edges = spark.createDataFrame([("t", "a", "b", "allele", "high"), ("t", "c", "d", "allele", "review"), ("t", "a", "e", "boundary-overlap", "high")], "target string, a string, b string, kind string, confidence string")
    groups = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 2)], "node string, group long")
    scores = [("a", "b", 9.0), ("d", "a", 5.0), ("c", "b", 5.0), ("c", "d", 8.0), ("a", "c", 3.0), ("b", "a", 0.0)]
    met = spark.createDataFrame(scores, "a string, b string, score double")
    rated = spark.createDataFrame([("x", min(a, b), max(a, b), s) for a, b, s in scores[:4] if {a, b} != {"a", "b"}] + [("x", "a", "b", 9.0)], "group string, row string, column string, score double")
    assert sorted((min(r[1], r[2]), max(r[1], r[2])) for r in rated.collect()) == [("a", "b"), ("a", "d"), ("b", "c"), ("c", "d")]
    matched = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")  # the best matching of groups 1 and 2: 9 + 8
    masks = loci.masked_pairs(edges, groups, met, matched)
    assert sorted(map(tuple, masks.collect())) == [("a", "b", "direct-allele"), ("a", "d", "cross-allele-nonmatch"), ("b", "c", "cross-allele-nonmatch")]
    found = spark.createDataFrame([("a", 3, "t", "+", "anchor"), ("b", 1, None, None, "no-paf-alignment"), ("c", 2, "t", "-", "multi-locus-split")], "node string, blocks long, target string, strand string, status string")
    one = loci.pruning_summary(found, edges, masks).first()
    assert (one.excluded, one.multi, one.split, one.repetitive, one.mixed, one.duplicate_pairs, one.anchors, one.direct_pairs, one.cross_pairs) == (3, 2, 2, 0, 0, 4, 1, 1, 2)
    turned = loci.pruning_summary(found.orderBy(F.desc("node")).repartition(3), edges.orderBy("a"), masks.orderBy(F.desc("b"))).first()
    assert turned == one
    assert loci.pruning_summary(found, edges.filter("a <> 'c'"), masks).first().fingerprint != one.fingerprint


def test_tiers_by_the_object_of_a_partner(spark):
    links = spark.createDataFrame([(1, 2, 9), (1, 3, 8), (1, 4, 7), (1, 5, 7)], "source long, target long, score long")
    placed = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c")], "block_id long, object_id string")
    out = recommend.tiered_partners(links, links.selectExpr("1 AS selected").distinct(), spark.createDataFrame([(1, "b"), (1, "b")], "selected long, object_id string"), 1, placed)
    assert sorted(map(tuple, out.collect())) == [(1, 2, 9, 1, 1), (1, 4, 7, 0, 1)]


# places


def test_typed_places(spark):
    rows = [(1, "o", 10, 0, 1000, "+", 0, 1), (2, "o", 20, 100, 600, "-", 0, 2), (3, "o", 30, 0, 50, "+", 0, 3), (4, "o", 30, 50, 90, "+", 0, 4)]
    placed = layout.with_visual(spark.createDataFrame(rows, LAYOUT)).withColumn("source_id", F.concat(F.lit("Ctg"), "source_id"))
    asked = [
        ("Ctg10", (1, 0, 1000, None)), (" ctg10 ", (1, 0, 1000, None)), ("2", (2, 1000, 1500, None)), ("Ctg20:150-250", (2, 1350, 1450, None)), ("Ctg10:1,0-9,00", (1, 10, 900, None)), ("Ctg30", (None, None, None, "ambiguous")), ("Ctg20:50-250", (None, None, None, "outside")),
        ("Ctg10:5", (None, None, None, "form")), ("Ctg10:9-5", (None, None, None, "order")), ("Ctg10:,-5", (None, None, None, "number")), ("Ctg10:0-99999999999999999", (None, None, None, "number")), ("", (None, None, None, "empty")), (None, (None, None, None, "empty")), ("Ctg9", (None, None, None, "missing")),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(asked)] + [(0, "Ctg10")], "id long, text string")
    found = {r.id: tuple(r)[1:] for r in navigation.jumps(placed, frame).collect()}
    assert found == {i: want for i, (_, want) in enumerate(asked)}


def test_what_a_view_shows_and_its_neighbours(spark):
    rows = [(k, "ab"[k // 6], k, 0, 100, "+", 0, k) for k in range(12)]
    placed = layout.with_visual(spark.createDataFrame(rows, LAYOUT))
    none = placed.filter("false")
    near = lambda view, chosen, flank: sorted(r[0] for r in navigation.view_neighbours(placed, view, chosen, flank).collect())
    assert near((0, 300, 650, 750), none, 1) == [0, 1, 2, 6, 7, 8]  # 700 is the start of block 7
    assert near((0, 300, 650, 740), none, 1) == [0, 1, 2, 6, 7]
    assert near((5000, 6000, 5000, 6000), placed.filter("block_id IN (0, 11)"), 1) == [0, 1, 10, 11]
    objects = lambda *a: sorted(r[0] for r in navigation.view_objects(placed, *a).collect())
    assert objects((0, 10, 590, 600)) == ["a"] and objects((0, 10, 590, 601)) == ["a", "b"]
    columns = spark.createDataFrame([("a", "h1"), ("c", "h1"), ("b", "h2")], "object_id string, column string")
    assert objects((0, 10, 0, 10), columns) == ["a", "c"]


def test_links_of_a_selection(spark):
    placed = layout.with_visual(spark.createDataFrame([(k, "o", k, 0, 100, "+", 0, k) for k in range(4)], LAYOUT))
    cells = spark.createDataFrame([(0, 1, 5.0), (0, 2, 7.0), (2, 3, 1.0), (1, 2, 2.0)], "x_bin long, y_bin long, count double")
    out = navigation.selected_links(cells, placed, 100, placed.filter("block_id IN (0, 1)"))
    assert sorted((r.source, r.target, r.raw_count) for r in out.collect()) == [(0, 2, 7.0), (1, 2, 2.0)]


def test_thinning_by_hash(spark):
    def plain(x, y):
        h = (((x & 0xFFFFFFFF) ^ 0x9E3779B9) * 0x85EBCA6B) & 0xFFFFFFFF
        h ^= (((y & 0xFFFFFFFF) ^ (h >> 16)) * 0xC2B2AE35) & 0xFFFFFFFF
        return h ^ (h >> 16)

    rng = random.Random(1)
    cells = sorted({(rng.randrange(2**33), rng.randrange(5000)) for _ in range(900)})
    frame = spark.createDataFrame([(x, y, 1.0) for x, y in cells], "x_bin long, y_bin long, count double")
    hashes = {(r.x_bin, r.y_bin): r.h for r in frame.select("x_bin", "y_bin", navigation.cell_hash(F.col("x_bin"), F.col("y_bin")).alias("h")).collect()}
    assert hashes == {c: plain(*c) for c in cells}
    kept = [c for c in cells if plain(*c) < int(100 / len(cells) * 2**32)][:100]
    assert sorted((r.x_bin, r.y_bin) for r in navigation.thinned(frame, 100).collect()) == kept
    assert navigation.thinned(frame, 900).count() == len(cells)


def test_bridges_over_gaps_and_counted_links(spark):
    rows = [(1, "o", 10, 0, 9, "+", 0, 1), (2, "o", 20, 0, 9, "-", 5, 2), (3, "o", 30, 0, 9, "+", 0, 3), (4, "o", 40, 0, 9, "+", 7, 4), (5, "p", 40, 0, 9, "+", 7, 5)]
    placed = spark.createDataFrame(rows, LAYOUT)
    links = spark.createDataFrame([(1, 10, "end", 20, "end"), (2, 20, "end", 10, "end"), (3, 10, "end", 20, "start"), (4, 20, "start", 30, "start"), (5, 30, "end", 40, "start"), (6, 10, "end", 99, "start")], "line_no long, from_segment long, from_side string, to_segment long, to_side string")
    assert sorted(map(tuple, navigation.gap_bridges(links, placed).collect())) == [(1, 1, 2, 5), (2, 1, 2, 5)]
    assert tuple(navigation.ambiguous_links(links, placed).first()) == (4, 1, 1)


@pytest.mark.parametrize("half", [False, True])
def test_dense_tiles_and_back(spark, half):
    values = [0.25, 1.0, 0.0, 2049.0, 65504.0, 0.1, 3.0]
    cells = [(k * 5, k * 7 % 11, v) for k, v in enumerate(values)]
    frame = spark.createDataFrame([*cells, (0, 0, 1.0)], "x_bin long, y_bin long, count double")
    packed = tiles.dense_tiles(frame, 4, half)
    assert {len(r.payload) for r in packed.collect()} == {16 * (2 if half else 4)}
    kind = np.float16 if half else np.float32
    want = {(x, y): float(kind(v + (1.0 if (x, y) == (0, 0) else 0))) for x, y, v in cells}
    assert {(r.x_bin, r.y_bin): r["count"] for r in tiles.dense_cells(packed, 4, half).collect()} == want
    if half:
        first = packed.filter("tile_x = 0 AND tile_y = 0").first().payload
        assert first[2:4] == b"\x00\xbc"  # an empty cell
    with pytest.raises(ValueError, match="bins"):
        tiles.dense_tiles(frame, 0)
    assert tiles.dense_cells(packed.limit(0), 4, half).count() == 0
