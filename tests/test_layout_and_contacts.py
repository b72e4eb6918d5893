"""The hand-computed workflow: a layout is read, moved, reversed, split, written and read again."""

from pyspark.sql import functions as F

from strandloom.operators import contacts, coverage, layout
from strandloom.sources import agp

AGP = """Chr01\t1\t4000\t1\tW\tctgA\t1\t4000\t+
Chr01\t4001\t4100\t2\tU\t100\tcontig\tno\tna
Chr01\t4101\t8100\t3\tW\tctgB\t1\t4000\t+
Chr02\t1\t4000\t1\tW\tctgC\t1\t4000\t+
Chr02\t4001\t4200\t2\tN\t200\tscaffold\tyes\tpaired-ends
Chr02\t4201\t8200\t3\tW\tctgD\t1\t4000\t+
"""
CONTACTS = [("ctgA", 0, "ctgA", 1000, 2.0), ("ctgA", 1000, "ctgB", 0, 3.0), ("ctgB", 0, "ctgB", 3000, 5.0), ("ctgB", 2000, "ctgD", 0, 11.0), ("ctgC", 0, "ctgD", 3000, 7.0)]
INPUT_1K = {(0, 1, 2.0), (1, 4, 3.0), (4, 7, 5.0), (6, 12, 11.0), (8, 15, 7.0)}
EDITED_1K = {(0, 7, 7.0), (4, 14, 11.0), (8, 9, 2.0), (9, 16, 3.0), (13, 16, 5.0)}
EDITED_2K = {(0, 3, 7.0), (2, 7, 11.0), (4, 4, 2.0), (4, 8, 3.0), (6, 8, 5.0)}


def rows(df):
    return {tuple(r) for r in df.collect()}


def contacts_of(spark):
    return spark.createDataFrame(CONTACTS, "source1 string, start1 long, source2 string, start2 long, count double")


def block(id, source, start, end, visual, orientation="+"):
    return (id, "o", source, start, end, orientation, visual, visual + end - start)


def placed(spark, *blocks):
    return spark.createDataFrame(list(blocks), "block_id long, object_id string, source_id string, source_start long, source_end long, orientation string, visual_start long, visual_end long")


def test_curation_workflow(spark, tmp_path):
    (tmp_path / "in.agp").write_text(AGP)
    parsed = agp.agp_rows(agp.numbered_lines(spark, str(tmp_path / "in.agp")))
    assert agp.summary(parsed).first().asDict() == {"lines": 6, "objects": 2, "components": 4, "gaps": 2, "span": 8200}
    base = layout.with_visual(agp.layout_of(parsed))
    assert base.agg(F.max("visual_end")).first()[0] == 16_300
    cells = contacts.project(contacts_of(spark), base, 1000)
    assert rows(cells) == INPUT_1K
    moved = layout.move_object_first(base, "Chr02")
    turned = layout.with_visual(layout.reverse(moved, F.col("source_id") == "ctgB"))
    edited = layout.with_visual(layout.split_at(turned, F.lit(14_300)))
    assert edited.agg(F.max("visual_end")).first()[0] == 16_400
    assert rows(contacts.project(contacts_of(spark), edited, 1000)) == EDITED_1K
    agp.write_agp(edited, str(tmp_path / "out.agp"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out.agp").glob("part-*")))
    assert text.splitlines()[3:] == ["Chr01\t1\t4000\t1\tW\tctgA\t1\t4000\t+", "Chr01\t4001\t4100\t2\tU\t100\tcontig\tno\tna", "Chr01\t4101\t6100\t3\tW\tctgB\t2001\t4000\t-", "Chr01\t6101\t6200\t4\tU\t100\tcontig\tno\tna", "Chr01\t6201\t8200\t5\tW\tctgB\t1\t2000\t-"]
    again = layout.with_visual(agp.layout_of(agp.agp_rows(agp.numbered_lines(spark, str(tmp_path / "out.agp")))))
    out = contacts.project(contacts_of(spark), again, 2000)
    assert rows(out) == EDITED_2K
    assert out.agg(F.sum("count")).first()[0] == 28.0


def test_reverse_mirrors_gaps(spark):
    data = [(i, "o", f"s{i}", 0, 10, "+", g, i) for i, g in [(1, 0), (2, 5), (3, 7), (4, 9)]]
    base = spark.createDataFrame(data, "block_id long, object_id string, source_id string, source_start long, source_end long, orientation string, gap_before long, ord long")
    out = [(r.block_id, r.orientation, r.gap_before) for r in layout.reverse(base, F.col("block_id").isin(2, 3)).orderBy("ord").collect()]
    assert out == [(1, "+", 0), (3, "-", 5), (2, "-", 7), (4, "+", 9)]


def test_copies_share_and_viewport_keeps_shares(spark):
    blocks = [block(i, "a", 0, 1000, 1000 * i) for i in range(2)] + [block(2 + i, "b", 0, 1000, 2000 + 1000 * i) for i in range(3)]
    one = spark.createDataFrame([("a", 0, "b", 0, 12.0)], "source1 string, start1 long, source2 string, start2 long, count double")
    cells = contacts.project(one, placed(spark, *blocks), 1000)
    assert rows(cells) == {(x, y, 2.0) for x in (0, 1) for y in (2, 3, 4)}
    assert rows(contacts.project(one, placed(spark, *blocks), 1000, (0, 1000, 2000, 3000))) == {(0, 2, 2.0)}


def test_zero_cells_stay(spark):
    one = spark.createDataFrame([("a", 0, "a", 500, 0.0)], "source1 string, start1 long, source2 string, start2 long, count double")
    assert rows(contacts.project(one, placed(spark, block(1, "a", 0, 1000, 0)), 100)) == {(0, 5, 0.0)}


def test_coverage_literals(spark):
    record = lambda *r: spark.createDataFrame(list(r), "chrom string, start long, end long, value double")
    whole = placed(spark, block(1, "contig-a", 0, 10_000, 0))
    assert rows(coverage.project_coverage(record(("contig-a", 0, 10_000, 42.0)), whole, 1000, 0, 4000)) == {(i, 42.0) for i in range(4)}
    assert rows(coverage.project_coverage(record(("contig-a", 0, 5000, 10.0), ("contig-a", 5000, 10_000, 30.0)), whole, 10_000)) == {(0, 20.0)}
    partial = placed(spark, block(1, "contig-a", 0, 2000, 0), block(2, "contig-a", 500, 1500, 2000))
    assert rows(coverage.project_coverage(record(("contig-a", 0, 2000, 60.0)), partial, 1000, 0, 3000)) == {(0, 45.0), (1, 45.0), (2, 30.0)}


def test_copy_runs_and_ranges(spark):
    base = placed(spark, block(1, "a", 0, 500, 0), block(2, "a", 500, 900, 500), block(3, "b", 0, 100, 900, "-"))
    runs = layout.split_copy_runs(base.withColumn("ord", F.col("block_id")))
    assert [r.copy_run for r in runs.orderBy("ord").collect()] == [1, 1, 2]
    assert rows(contacts.viewport_ranges(base, 400, 950)) == {("a", 400, 500), ("a", 500, 900), ("b", 50, 100)}
