"""Curation operators: histories, names and units by hand, and consolidated alignments against a plain version."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strandloom.operators import curation, layout, synteny

SCHEMA = "block_id long, object_id string, source_id string, source_start long, source_end long, orientation string, gap_before long, ord long"


def blocks(spark, *rows):
    """Blocks (object, gap before) of 10 bases in their order, with ids from 1."""
    return spark.createDataFrame([(i, o, f"s{i}", 0, 10, "+", g, i) for i, (o, g) in enumerate(rows, 1)], SCHEMA)


def told(df):
    return [(r.block_id, r.object_id, r.gap_before) for r in df.orderBy("ord").collect()]


def test_gaps_are_repaired(spark):
    base = blocks(spark, ("a", 7), ("a", 0), ("a", 50), ("b", 0), ("b", 60))
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "block_id long")
    assert told(curation.delete_repaired(base, gone(4))) == [(1, "a", 0), (2, "a", 0), (3, "a", 50), (5, "b", 0)]
    assert told(curation.delete_repaired(base, gone())) == [(1, "a", 0), (2, "a", 0), (3, "a", 50), (4, "b", 0), (5, "b", 60)]
    assert told(curation.move_to_debris(base, gone(2))) == [(3, "a", 0), (4, "b", 0), (5, "b", 60), (1, "debris", 0), (2, "debris", 0)]
    assert told(curation.move_to_debris(base, gone(3, 4))) == [(1, "a", 0), (2, "a", 0), (5, "b", 0), (3, "debris", 0), (4, "debris", 50)]
    moved = curation.apply_recommendation(base, F.col("block_id") == 5, 3, behind=False, turned=True)
    assert told(moved) == [(1, "a", 0), (2, "a", 0), (5, "a", 60), (3, "a", 50), (4, "b", 0)] and moved.filter("orientation = '-'").count() == 1
    assert told(curation.apply_recommendation(base, F.col("block_id") == 5, 99, behind=True, turned=False))[-1] == (5, "b", 60)
    assert told(curation.delete_repaired(base.limit(0), gone(1))) == []


def test_names(spark):
    base = blocks(spark, ("a", 0), ("b", 0), ("c", 0))
    asked = spark.createDataFrame([("a", " x "), ("b", "c"), ("c", None)], "object_id string, name string")
    assert sorted((r.object_id, r.error) for r in curation.rename_errors(base, asked).collect()) == [("a", None), ("b", "taken"), ("c", "empty")]
    assert [o for _, o, _ in told(curation.rename_objects(base, asked))] == ["x", "b", "c"]


def test_history_survives_json(spark):
    base = blocks(spark, ("a", 0), ("a", 5), ("b", 0))
    history = curation.History.of(base).do(base.filter("ord > 1")).do(base.limit(0)).undo()
    lines = curation.history_lines(history, "key")
    again = curation.read_history(lines, "key")
    assert (again.shown, told(again.layout)) == (1, told(history.layout))
    for broken in (lines.limit(0), lines.union(spark.createDataFrame([("{",)], "value string"))):
        with pytest.raises(ValueError):
            curation.read_history(broken, "key")
    with pytest.raises(ValueError):
        curation.read_history(lines, "other")


def plain_consolidated(rows, minimum):
    """Best chains by a quadratic recurrence, then the share of the best, then the winner of every base."""
    chains = []
    for q, t in sorted({(r[0], r[1]) for r in rows}):
        best = None
        for strand in "+-":
            own = sorted((r[3], r[4], *((r[5], r[6]) if strand == "+" else (-r[6], -r[5])), r[7], r[8], r[9]) for r in rows if (r[0], r[1], r[2]) == (q, t, strand))
            cut = [(r[1] - min(1000, (r[1] - r[0]) // 2), r[3] - min(1000, (r[3] - r[2]) // 2)) for r in own]
            state = []
            for i, r in enumerate(own):
                score, chain = (r[3] - r[2], r[4], r[5], r[6] * r[5], -1), [r]
                before = max((state[j][0] for j in range(i) if cut[j][0] <= r[0] and cut[j][1] <= r[2]), default=None)
                if before is not None:
                    j = next(j for j in range(i) if cut[j][0] <= r[0] and cut[j][1] <= r[2] and state[j][0] == before)
                    score, chain = tuple(a + b for a, b in zip(before, score, strict=True)), [*state[j][1], r]
                state.append((score, chain))
            if state:
                top = max(s for s, _ in state)
                chain = next(c for s, c in state if s == top)
                if best is None or top > best[0]:
                    best = (top, strand, chain)
        top, strand, chain = best
        low, high = min(r[2] for r in chain), max(r[3] for r in chain)
        low, high = (-high, -low) if strand == "-" else (low, high)
        if top[0] >= minimum:
            chains.append((q, t, strand, min(r[0] for r in chain), max(r[1] for r in chain), low, high, sum(r[4] for r in chain), sum(r[5] for r in chain), min(r[6] for r in chain), top[0]))
    chains = [c for c in chains if c[10] * 5 >= max(d[10] for d in chains if d[0] == c[0])]
    out = []
    for q in sorted({c[0] for c in chains}):
        own = [c for c in chains if c[0] == q]
        ends = sorted({x for c in own for x in c[3:5]})
        runs = []
        for a, b in zip(ends, ends[1:], strict=False):
            over = [c for c in own if c[3] <= a and c[4] >= b]
            if over:
                win = min(over, key=lambda c: (-c[9], -Fraction(c[7], c[8]), -c[7], c[3] - c[4], c[1], c[2]))
                if runs and runs[-1][2] is win and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b, win])
        out += [(q, c[1], c[2], a, b) for a, b, c in runs]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_consolidated_alignments_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        q, t, n = rng.randint(1, 4), rng.randint(1, 4), rng.randint(100, 6000)
        s, at = rng.randint(0, 40_000), rng.randint(0, 40_000)
        rows.append((q, t, rng.choice("+-"), s, s + n, at, at + n + rng.randint(-50, 50), n * rng.randint(60, 99) // 100, n, rng.choice([0, 10, 60])))
    names = "query_name long, target_name long, strand string, query_start long, query_end long, target_start long, target_end long, matches long, block_len long, mapq int"
    found = synteny.consolidate(spark.createDataFrame(rows, names), 4000).collect()
    assert sorted((r.query_name, r.target_name, r.strand, r.query_start, r.query_end) for r in found) == plain_consolidated(rows, 4000)
    for r in found:
        assert r.target_start < r.target_end and r.matches >= 1 and r.block_len >= 1
    assert synteny.consolidate(spark.createDataFrame([], names), 1).count() == 0


def test_units(spark):
    base = layout.with_visual(blocks(spark, ("a", 0), ("a", 0), ("a", 5), ("b", 9)))
    assert [r.unit for r in curation.with_units(base).orderBy("ord").collect()] == [1, 1, 3, 4]
    groups = {r.object_id: r for r in curation.chromosome_groups(base, F.col("block_id") == 2).collect()}
    assert (groups["a"].total_count, groups["a"].selected_count, groups["a"].selected_length, groups["b"].selected_count) == (2, 1, 20, 0)
