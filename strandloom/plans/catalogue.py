"""The queries of the interval and matrix operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import intervals, stats
from strandloom.functions.storage import materialise, table
from strandloom.operators import assembly_graph, balance, contacts, coverage, evidence, graph, layout, pyramid, recommend, synteny
from strandloom.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name; the SQL may use the views by name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            head, body = (sql[len("RECURSIVE ") :].split(";;") if sql.startswith("RECURSIVE ") else ("", sql)) if ";;" in sql else ("", sql)
            ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {views.SQL.strip()}, {head} {body}" if head else f"WITH {views.SQL.strip()}{body if body.startswith(chr(44)) else chr(32) + body}")
        return f

    return add


# layout

@query("SELECT block_id, object_id, source_id, ord, visual_start, visual_end FROM layout")
def q_layout_visual(spark, sf):
    return views.layout(spark, sf).select("block_id", "object_id", "source_id", "ord", "visual_start", "visual_end")


@query("""SELECT object_id, CAST(object_beg + 1 AS BIGINT) AS object_beg, CAST(object_end AS BIGINT) AS object_end, part_number, component_type, component, component_beg, component_end, orientation FROM (
  SELECT object_id, e - length - CASE WHEN kind = 0 THEN 0 ELSE 0 END AS object_beg, e AS object_end, row_number() OVER (PARTITION BY object_id ORDER BY ord, kind) AS part_number, component_type, component, component_beg, component_end, orientation
  FROM (SELECT *, sum(length) OVER (PARTITION BY object_id ORDER BY ord, kind ROWS UNBOUNDED PRECEDING) AS e FROM (
    SELECT object_id, ord, 0 AS kind, gap_before AS length, 'U' AS component_type, CAST(gap_before AS VARCHAR) AS component, 'contig' AS component_beg, 'no' AS component_end, 'na' AS orientation FROM layout
    WHERE gap_before > 0 AND ord > (SELECT min(ord) FROM layout l2 WHERE l2.object_id = layout.object_id)
    UNION ALL SELECT object_id, ord, 1, source_end - source_start, 'W', CAST(source_id AS VARCHAR), CAST(source_start + 1 AS VARCHAR), CAST(source_end AS VARCHAR), orientation FROM layout)))""")
def q_agp_export(spark, sf):
    from strandloom.sources.agp import export_rows

    return export_rows(views.layout(spark, sf)).select("object_id", "object_beg", "object_end", "part_number", "component_type", "component", "component_beg", "component_end", "orientation")


@query("""SELECT block_id, object_id, ord, CASE WHEN n > 1 THEN object_id || '_block_' || dense_rank() OVER (PARTITION BY object_id, n > 1 ORDER BY run) END AS assembly_block_id FROM (
  SELECT *, count(*) OVER (PARTITION BY object_id, run) AS n FROM (SELECT *, sum(CASE WHEN source_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY object_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM layout))""")
def q_joined_runs(spark, sf):
    gaps = views.layout(spark, sf).withColumn("gap_before", F.when(F.col("source_id") % 4 == 0, 100).otherwise(0))
    return layout.joined_runs(gaps).select("block_id", "object_id", "ord", "assembly_block_id")


_ORDERED = "block_id, object_id, source_id, source_start, source_end, orientation, gap_before"


@query(f"SELECT {_ORDERED}, row_number() OVER (ORDER BY CASE WHEN object_id = 'Brand#23' THEN 0 ELSE 1 END, ord) AS ord FROM layout")
def q_edit_move_object(spark, sf):
    return layout.move_object_first(views.layout(spark, sf), "Brand#23")


@query("""SELECT b.block_id, b.object_id, b.source_id, b.source_start, b.source_end, CASE WHEN sel THEN CASE orientation WHEN '+' THEN '-' ELSE '+' END ELSE orientation END AS orientation, b.gap_before,
  CASE WHEN sel THEN lo + hi - ord ELSE ord END AS ord FROM (SELECT *, min(ord) OVER (PARTITION BY object_id, sel, run) AS lo, max(ord) OVER (PARTITION BY object_id, sel, run) AS hi FROM (
    SELECT *, source_id % 5 < 3 AS sel, sum(CASE WHEN source_id % 5 < 3 AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY object_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, lag(source_id % 5 < 3) OVER (PARTITION BY object_id ORDER BY ord) AS prev FROM layout))) b""")
def q_edit_reverse(spark, sf):
    base = views.layout(spark, sf)
    return layout.reverse(base, F.col("source_id") % 5 < 3)


@query("""SELECT block_id * 2 + side AS block_id, object_id, source_id, CASE WHEN NOT inside THEN source_start WHEN (orientation = '-') = (side = 0) THEN cut ELSE source_start END AS source_start,
  CASE WHEN NOT inside THEN source_end WHEN (orientation = '-') = (side = 0) THEN source_end ELSE cut END AS source_end, orientation, CASE WHEN side = 1 THEN 100 ELSE gap_before END AS gap_before, ord * 2 + side AS ord FROM (
  SELECT *, (visual_start + visual_end) // 2 > visual_start AND source_id % 7 = 0 AS inside,
    CASE WHEN orientation = '-' THEN source_end - ((visual_start + visual_end) // 2 - visual_start) ELSE source_start + (visual_start + visual_end) // 2 - visual_start END AS cut,
    unnest(CASE WHEN source_id % 7 = 0 THEN [0, 1] ELSE [0] END) AS side FROM layout)""")
def q_edit_split(spark, sf):
    middle = F.when(F.col("source_id") % 7 == 0, F.expr("(visual_start + visual_end) div 2"))
    return layout.split_at(views.layout(spark, sf), F.coalesce(middle, F.lit(-1)))


@query("SELECT block_id, object_id, source_id, ord FROM layout WHERE source_id % 3 <> 1")
def q_edit_delete(spark, sf):
    base = views.layout(spark, sf)
    return layout.delete_blocks(base, base.filter("source_id % 3 = 1").select("block_id")).select("block_id", "object_id", "source_id", "ord")


@query("""SELECT block_id, object_id, source_id, source_start, source_end, orientation, gap_before, ord FROM layout UNION ALL
  SELECT (SELECT max(block_id) FROM layout) + block_id + 1, 'debris', source_id, source_start, source_end, orientation, gap_before, (SELECT max(ord) FROM layout) + ord FROM layout WHERE source_id % 11 = 0""")
def q_edit_copy(spark, sf):
    base = views.layout(spark, sf)
    return layout.copy_blocks(base, base.filter("source_id % 11 = 0").select("block_id"), "debris")


# contacts

_PROJECT = """p AS (SELECT least(x, y) AS x, greatest(x, y) AS y, share FROM (
  SELECT CASE WHEN a.orientation = '-' THEN a.visual_start + a.source_end - start1 - 1 ELSE a.visual_start + start1 - a.source_start END AS x,
    CASE WHEN b.orientation = '-' THEN b.visual_start + b.source_end - start2 - 1 ELSE b.visual_start + start2 - b.source_start END AS y, count / (na.n * nb.n) AS share
  FROM contact JOIN layout a ON source1 = a.source_id AND start1 >= a.source_start AND start1 < a.source_end JOIN layout b ON source2 = b.source_id AND start2 >= b.source_start AND start2 < b.source_end
  JOIN (SELECT source_id, count(*) AS n FROM layout GROUP BY 1) na ON na.source_id = source1 JOIN (SELECT source_id, count(*) AS n FROM layout GROUP BY 1) nb ON nb.source_id = source2))"""


def _project_sql(body: str) -> str:
    return f"RECURSIVE {_PROJECT};;{body}"


@query(_project_sql("SELECT x // 50000 AS x_bin, y // 50000 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2"))
def q_contact_project(spark, sf):
    return contacts.project(views.contact(spark, sf), views.layout(spark, sf), 50_000)


@query(_project_sql("SELECT x // 10000 AS x_bin, y // 10000 AS y_bin, sum(share) AS count FROM p WHERE x >= 1000000 AND x < 9000000 AND y >= 3000000 AND y < 20000000 GROUP BY 1, 2"))
def q_contact_viewport(spark, sf):
    return contacts.project(views.contact(spark, sf), views.layout(spark, sf), 10_000, (1_000_000, 9_000_000, 3_000_000, 20_000_000))


@query(_project_sql("""SELECT x // 10000 AS x_bin, y // 10000 AS y_bin, sum(share) AS count FROM p WHERE (x >= 9000000 AND x < 30000000 AND y >= 1000000 AND y < 20000000)
  OR (y >= 9000000 AND y < 30000000 AND x >= 1000000 AND x < 20000000) GROUP BY 1, 2"""))
def q_contact_symmetric(spark, sf):
    return contacts.project(views.contact(spark, sf), views.layout(spark, sf), 10_000, (9_000_000, 30_000_000, 1_000_000, 20_000_000), symmetric=True)


@query(_project_sql("SELECT x_bin // 64 AS tile_x, y_bin // 64 AS tile_y, count(*) AS cells, sum(count) AS total FROM (SELECT x // 5000 AS x_bin, y // 5000 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2) GROUP BY 1, 2"))
def q_contact_tiles(spark, sf):
    return contacts.tiles(contacts.project(views.contact(spark, sf), views.layout(spark, sf), 5_000), 64)


@query(_project_sql("""SELECT x_bin, y_bin, count FROM (SELECT x // 5000 AS x_bin, y // 5000 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2)
  WHERE (x_bin // 64, y_bin // 64) IN (SELECT (least(source_id % 40, length // 1000), greatest(source_id % 40, length // 1000)) FROM contig)"""))
def q_requested_tiles(spark, sf):
    wanted = views.contig(spark, sf).select((F.col("source_id") % 40).alias("tile_x"), F.expr("length div 1000").alias("tile_y"))
    return contacts.requested_tiles(contacts.project(views.contact(spark, sf), views.layout(spark, sf), 5_000), wanted, 64)


@query("""SELECT source_id, CASE WHEN orientation = '-' THEN source_end - (least(visual_end, 25000000) - visual_start) ELSE source_start + greatest(visual_start, 2000000) - visual_start END AS start,
  CASE WHEN orientation = '-' THEN source_end - (greatest(visual_start, 2000000) - visual_start) ELSE source_start + least(visual_end, 25000000) - visual_start END AS "end"
  FROM layout WHERE visual_end > 2000000 AND visual_start < 25000000""")
def q_viewport_ranges(spark, sf):
    return contacts.viewport_ranges(views.layout(spark, sf), 2_000_000, 25_000_000)


@query("""SELECT c.* FROM contact c WHERE EXISTS (SELECT 1 FROM contig WHERE source_id = source1 AND start1 < length // 2) AND EXISTS (SELECT 1 FROM contig WHERE source_id = source2 AND start2 < length // 2)""")
def q_selected_ranges(spark, sf):
    ranges = views.contig(spark, sf).select("source_id", F.lit(0).cast("long").alias("start"), F.expr("length div 2").alias("end"))
    return contacts.select_ranges(views.contact(spark, sf), ranges)


@query("SELECT source_id, w1, w2, CAST(sum(count) AS BIGINT) AS count FROM (SELECT source1 AS source_id, least(start1, start2) // 5000 AS w1, greatest(start1, start2) // 5000 AS w2, count FROM contact WHERE source1 = source2) GROUP BY 1, 2, 3")
def q_window_pairs(spark, sf):
    inner = views.contact(spark, sf).filter("source1 = source2")
    keyed = inner.select(F.col("source1").alias("source_id"), F.expr("least(start1, start2) div 5000").alias("w1"), F.expr("greatest(start1, start2) div 5000").alias("w2"), "count")
    return keyed.groupBy("source_id", "w1", "w2").agg(F.sum("count").alias("count"))


# coverage

_COVER = """seg AS (SELECT l.*, count(*) OVER (PARTITION BY source_id) AS copies FROM layout l),
part0 AS (SELECT value / copies AS share, CASE WHEN orientation = '-' THEN visual_start + source_end - least("end", source_end) ELSE visual_start + greatest(start, source_start) - source_start END AS lo,
  CASE WHEN orientation = '-' THEN visual_start + source_end - greatest(start, source_start) ELSE visual_start + least("end", source_end) - source_start END AS hi FROM cov JOIN seg ON chrom = source_id AND start < source_end AND "end" > source_start),
part1 AS (SELECT share, lo, hi, unnest(range(lo // 10000, (hi - 1) // 10000 + 1)) AS x_bin FROM part0 WHERE lo < hi)"""


@query(f"RECURSIVE {_COVER};;SELECT x_bin, round(sum(share * (least(hi, (x_bin + 1) * 10000) - greatest(lo, x_bin * 10000))) / sum(least(hi, (x_bin + 1) * 10000) - greatest(lo, x_bin * 10000)), 6) AS value FROM part1 GROUP BY 1")
def q_coverage(spark, sf):
    return coverage.project_coverage(views.cov(spark, sf), views.layout(spark, sf), 10_000).select("x_bin", F.round("value", 6).alias("value"))


# intervals

_ISLANDS = """isl AS (SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS members FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS i FROM (
  SELECT *, CASE WHEN max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} >= start THEN 0 ELSE 1 END AS fresh FROM cov WHERE start < "end")) GROUP BY chrom, i)"""


@query(f"RECURSIVE {_ISLANDS.format(gap=0)};;SELECT chrom, start, \"end\", members FROM isl")
def q_ranges_merge(spark, sf):
    return intervals.merge_touching(views.cov(spark, sf), ["chrom"])


@query(f"RECURSIVE {_ISLANDS.format(gap=2000)};;SELECT chrom, start, \"end\", members FROM isl")
def q_clusters(spark, sf):
    return intervals.merge_touching(views.cov(spark, sf), ["chrom"], gap=2000)


@query(f"RECURSIVE {_ISLANDS.format(gap=0)};;SELECT chrom, CAST(sum(\"end\" - start) AS BIGINT) AS span FROM isl GROUP BY 1")
def q_interval_union(spark, sf):
    return intervals.union_span(views.cov(spark, sf), ["chrom"])


_TWO = """a0 AS (SELECT chrom, start, "end" FROM cov WHERE value >= 25), b0 AS (SELECT chrom, start, "end" FROM cov WHERE value < 25),
a1 AS (SELECT chrom, min(start) AS s, max("end") AS e FROM (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS f FROM a0 WHERE start < "end")) GROUP BY chrom, i),
b1 AS (SELECT chrom, min(start) AS s, max("end") AS e FROM (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS f FROM b0 WHERE start < "end")) GROUP BY chrom, i)"""


@query(f"RECURSIVE {_TWO};;SELECT a1.chrom, CAST(sum(least(a1.e, b1.e) - greatest(a1.s, b1.s)) AS BIGINT) AS span FROM a1 JOIN b1 ON a1.chrom = b1.chrom AND a1.s < b1.e AND b1.s < a1.e GROUP BY 1")
def q_interval_intersection(spark, sf):
    base = views.cov(spark, sf)
    return intervals.intersection_span(base.filter("value >= 25"), base.filter("value < 25"), ["chrom"])


@query("""SELECT c.chrom, c.start, c."end", count(*) AS holders FROM (SELECT DISTINCT chrom, start, "end" FROM cov) c JOIN paf ON chrom = query_name AND start >= query_start AND start < query_end GROUP BY 1, 2, 3""")
def q_point_in_interval(spark, sf):
    points = views.cov(spark, sf).select("chrom", "start", "end").distinct()
    held = intervals.covering(points, ["chrom"], "start", views.paf(spark, sf).select(F.col("query_name").alias("chrom"), "query_start", "query_end"), "query_start", "query_end", 2000)
    return held.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("holders"))


# matrices

_SYM = "sym AS (SELECT bin1_id AS i, bin2_id AS j, count FROM pixel UNION ALL SELECT bin2_id, bin1_id, count FROM pixel WHERE bin1_id <> bin2_id)"


@query(f"RECURSIVE {_SYM};;SELECT i AS bin_id, CAST(sum(count) AS BIGINT) AS total, count(*) AS nonzeros FROM sym GROUP BY 1")
def q_row_sums(spark, sf):
    return balance.row_sums(views.pixel(spark, sf))


@query(f"RECURSIVE {_SYM};;SELECT i AS bin_id, CAST(sum(count * (j % 7 + 1)) AS BIGINT) AS value FROM sym GROUP BY 1")
def q_spmv(spark, sf):
    pixels = views.pixel(spark, sf)
    vector = pyramid.bins(views.chrom(spark, sf), 1000).select("bin_id", (F.col("bin_id") % 7 + 1).alias("w"))
    return balance.multiply(pixels, vector)


_CIS = """cis AS (SELECT p.* FROM pixel p JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id WHERE a.chrom_id = b.chrom_id),
csym AS (SELECT bin1_id AS i, bin2_id AS j, count FROM cis UNION ALL SELECT bin2_id, bin1_id, count FROM cis WHERE bin1_id <> bin2_id),
cw AS (SELECT i AS bin_id, {w} AS w FROM csym GROUP BY 1),
cs AS (SELECT b.chrom_id, sqrt(sum(count * m) / sum(count * x.w * y.w * m)) AS s FROM (SELECT *, CASE WHEN bin1_id = bin2_id THEN 1 ELSE 2 END AS m FROM cis) JOIN cw x ON x.bin_id = bin1_id JOIN cw y ON y.bin_id = bin2_id JOIN bins b ON b.bin_id = bin1_id GROUP BY 1)"""


@query(f"RECURSIVE {_CIS.format(w='1.0::DOUBLE / sum(count)')};;SELECT bin_id, round(w * s, 6) AS w FROM cw JOIN bins USING (bin_id) JOIN cs USING (chrom_id)")
def q_vc(spark, sf):
    pixels = materialise(views.pixel(spark, sf), "pixels")
    return balance.vanilla(pixels, pyramid.bins(views.chrom(spark, sf), 1000)).select("bin_id", F.round("w", 6).alias("w"))


@query(f"RECURSIVE {_CIS.format(w='sqrt(1.0::DOUBLE / sum(count))')};;SELECT bin_id, round(w * s, 6) AS w FROM cw JOIN bins USING (bin_id) JOIN cs USING (chrom_id)")
def q_vc_sqrt(spark, sf):
    pixels = materialise(views.pixel(spark, sf), "pixels")
    return balance.vanilla(pixels, pyramid.bins(views.chrom(spark, sf), 1000), square_root=True).select("bin_id", F.round("w", 6).alias("w"))


def _ice_sql(steps: int) -> str:
    ctes = [_SYM, "w0 AS (SELECT DISTINCT i AS bin_id, 1.0::DOUBLE AS w FROM sym)"]
    for k in range(steps):
        ctes.append(f"m{k} AS (SELECT i AS bin_id, sum(count * b.w) * any_value(a.w) AS m, any_value(a.w) AS w FROM sym JOIN w{k} a ON a.bin_id = i JOIN w{k} b ON b.bin_id = j GROUP BY 1)")
        ctes.append(f"w{k + 1} AS (SELECT bin_id, w / sqrt(m / (SELECT avg(m) FROM m{k})) AS w FROM m{k})")
    return f"RECURSIVE {', '.join(ctes)};;SELECT bin_id, round(w, 6) AS w FROM w{steps}"


@query(_ice_sql(3))
def q_ice_k3(spark, sf):
    pixels = materialise(views.pixel(spark, sf), "pixels")
    matrix = materialise(balance.both_triangles(pixels), "matrix")
    weights = balance.row_sums(pixels).select("bin_id", F.lit(1.0).alias("w"))
    for _ in range(3):
        weights = materialise(balance.ice_step(matrix, weights).select("bin_id", "w"), "ice")
    return weights.select("bin_id", F.round("w", 6).alias("w"))


_COARSE = """up AS (SELECT b.bin_id AS parent_id, c.base + b.start // {r} AS bin_id FROM bins b JOIN (SELECT chrom_id, CAST(coalesce(sum((length + {r} - 1) // {r}) OVER (ORDER BY chrom_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM chrom) c USING (chrom_id)),
low AS (SELECT x.bin_id AS bin1_id, y.bin_id AS bin2_id, CAST(sum(count) AS BIGINT) AS count FROM pixel JOIN up x ON x.parent_id = bin1_id JOIN up y ON y.parent_id = bin2_id GROUP BY 1, 2)"""


@query(f"RECURSIVE {_COARSE.format(r=20000)};;SELECT bin1_id, bin2_id, count FROM low")
def q_pyramid_chain(spark, sf):
    return pyramid.build_levels(views.pixel(spark, sf), views.chrom(spark, sf), [1000, 5000, 10000, 20000], 1000)[20000]


@query(f"RECURSIVE {_COARSE.format(r=20000)};;SELECT bin1_id, bin2_id, count FROM low")
def q_pyramid_direct(spark, sf):
    return pyramid.build_levels(views.pixel(spark, sf), views.chrom(spark, sf), [1000, 20000], 1000, direct=True)[20000]


@query("""SELECT base + k AS bin_id, chrom_id, k * 7000 AS start, least((k + 1) * 7000, length) AS "end" FROM (SELECT base, chrom_id, length, unnest(range(0, (length + 6999) // 7000)) AS k FROM (
  SELECT chrom_id, length, CAST(coalesce(sum((length + 6999) // 7000) OVER (ORDER BY chrom_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM chrom))""")
def q_pyramid_bins(spark, sf):
    return pyramid.bins(views.chrom(spark, sf), 7000)


@query("SELECT bin_id, CAST(coalesce(sum(n) OVER (ORDER BY bin_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bin1_offset FROM (SELECT b.bin_id, count(p.bin1_id) AS n FROM bins b LEFT JOIN pixel p ON p.bin1_id = b.bin_id GROUP BY 1)")
def q_row_offsets(spark, sf):
    return pyramid.row_offsets(views.pixel(spark, sf), pyramid.bins(views.chrom(spark, sf), 1000))


# alignments

@query("SELECT aln_id, query_name, target_name, matches FROM (SELECT *, max(block_len) OVER (PARTITION BY query_name) AS best FROM paf) WHERE block_len * 5 >= best")
def q_paf_global_filter(spark, sf):
    return synteny.keep_near_best(views.paf(spark, sf), "block_len").select("aln_id", "query_name", "target_name", "matches")


@query("""RECURSIVE good AS (SELECT * FROM paf WHERE query_end > query_start), cuts AS (SELECT query_name, query_start AS pos FROM good UNION SELECT query_name, query_end FROM good),
pieces AS (SELECT * FROM (SELECT query_name, pos, lead(pos) OVER (PARTITION BY query_name ORDER BY pos) AS stop FROM cuts) WHERE stop IS NOT NULL),
win AS (SELECT * FROM (SELECT p.query_name, pos, stop, target_name, strand, aln_id, row_number() OVER (PARTITION BY p.query_name, pos ORDER BY mapq DESC, matches::DECIMAL(20,0) * 1000000 // block_len DESC, matches DESC, query_end - query_start DESC, target_name, strand, target_start, aln_id) AS k
  FROM pieces p JOIN good r ON p.query_name = r.query_name AND query_start <= pos AND query_end >= stop) WHERE k = 1),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY query_name ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(aln_id) OVER w = aln_id AND lag(stop) OVER w = pos THEN 0 ELSE 1 END AS fresh FROM win WINDOW w AS (PARTITION BY query_name ORDER BY pos)));;
SELECT query_name, target_name, strand, aln_id, min(pos) AS start, max(stop) AS "end" FROM runs GROUP BY query_name, run, target_name, strand, aln_id""")
def q_paf_arbitrate(spark, sf):
    return synteny.arbitrate(views.paf(spark, sf).filter("query_end > query_start"))


@query("""SELECT block_id, query_name, target_name, CASE WHEN orientation = '-' THEN CASE strand WHEN '+' THEN '-' ELSE '+' END ELSE strand END AS strand,
  CASE WHEN orientation = '-' THEN visual_start + source_end - query_end ELSE visual_start + query_start END AS visual_start, CASE WHEN orientation = '-' THEN visual_start + source_end - query_start ELSE visual_start + query_end END AS visual_end,
  target_start, target_end, mapq FROM paf JOIN layout ON query_name = source_id WHERE mapq >= 16 AND query_end - query_start >= 1000""")
def q_paf_project(spark, sf):
    return synteny.project_alignments(views.paf(spark, sf), views.layout(spark, sf), 16, 1000)


@query(None)
def q_paf_chain(spark, sf):
    return synteny.chains(views.paf(spark, sf), 1000)


@query("""RECURSIVE pr AS (SELECT block_id, query_name, target_name, CASE WHEN orientation = '-' THEN CASE strand WHEN '+' THEN '-' ELSE '+' END ELSE strand END AS strand,
  CASE WHEN orientation = '-' THEN visual_start + source_end - query_end ELSE visual_start + query_start END AS vs, CASE WHEN orientation = '-' THEN visual_start + source_end - query_start ELSE visual_start + query_end END AS ve, target_start AS ts, target_end AS te, mapq
  FROM paf JOIN layout ON query_name = source_id WHERE mapq >= 0 AND query_end - query_start >= 1),
o AS (SELECT *, row_number() OVER (PARTITION BY block_id, query_name, target_name, strand ORDER BY vs, ts, ve, te) AS k FROM pr),
f AS (SELECT *, 1 AS n, 1 AS run FROM o WHERE k = 1 UNION ALL SELECT block_id, query_name, target_name, strand, CASE WHEN j THEN fvs ELSE vs END, CASE WHEN j THEN greatest(fve, ve) ELSE ve END, CASE WHEN j THEN least(fts, ts) ELSE ts END, CASE WHEN j THEN greatest(fte, te) ELSE te END, CASE WHEN j THEN least(fm, mapq) ELSE mapq END, k, CASE WHEN j THEN fn + 1 ELSE 1 END, CASE WHEN j THEN run ELSE run + 1 END
  FROM (SELECT o.*, f.vs AS fvs, f.ve AS fve, f.ts AS fts, f.te AS fte, f.mapq AS fm, f.n AS fn, f.run, o.vs - f.ve <= 5000 AND greatest(o.ts, f.ts) - least(o.te, f.te) <= 300000 AS j FROM f JOIN o ON o.block_id = f.block_id AND o.query_name = f.query_name AND o.target_name = f.target_name AND o.strand = f.strand AND o.k = f.k + 1));;
SELECT block_id, query_name, target_name, strand, vs AS visual_start, ve AS visual_end, ts AS target_start, te AS target_end, CAST(mapq AS INTEGER) AS mapq, CAST(n AS BIGINT) AS alignments FROM (SELECT *, row_number() OVER (PARTITION BY block_id, query_name, target_name, strand, run ORDER BY k DESC) AS last FROM f) WHERE last = 1""")
def q_paf_gap_merge(spark, sf):
    return synteny.merge_gaps(synteny.project_alignments(views.paf(spark, sf), views.layout(spark, sf), 0, 1), 5000, 300_000)


@query("""SELECT query_name, target_name, CAST(sum(block_len) AS BIGINT) AS bases, round(sum(matches) / sum(block_len), 6) AS identity, round(sum(mapq * block_len) / sum(block_len), 6) AS mapq,
  round(greatest(sum(CASE WHEN strand = '+' THEN block_len ELSE 0 END), sum(CASE WHEN strand = '+' THEN 0 ELSE block_len END)) / sum(block_len), 6) AS strand_share FROM paf WHERE block_len > 0 GROUP BY 1, 2""")
def q_locus_stats(spark, sf):
    out = evidence.locus_stats(views.paf(spark, sf).filter("block_len > 0"))
    return out.select("query_name", "target_name", "bases", *[F.round(c, 6).alias(c) for c in ("identity", "mapq", "strand_share")])


# evidence

_LINKS = "links AS (SELECT least(source1, source2) AS source, greatest(source1, source2) AS target, CAST(sum(count) AS BIGINT) AS score FROM contact WHERE source1 <> source2 GROUP BY 1, 2)"


def _links(spark, sf):
    pairs = views.contact(spark, sf).filter("source1 <> source2")
    return pairs.groupBy(F.least("source1", "source2").alias("source"), F.greatest("source1", "source2").alias("target")).agg(F.sum("count").alias("score"))


_ENDS = """ends2 AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC, source, target) AS rank FROM (SELECT *, source AS e FROM links UNION ALL SELECT *, target FROM links))"""


@query(f"RECURSIVE {_LINKS}, {_ENDS};;SELECT DISTINCT source, target, score FROM ends2 WHERE rank <= 3")
def q_topk_or(spark, sf):
    return evidence.top_partners(_links(spark, sf), 3)


@query(f"RECURSIVE {_LINKS}, {_ENDS};;SELECT source, target, score FROM ends2 WHERE rank <= 5 GROUP BY ALL HAVING count(*) = 2")
def q_topk_and(spark, sf):
    return evidence.top_partners(_links(spark, sf), 5, both=True)


@query(f"RECURSIVE {_LINKS}, {_ENDS};;SELECT source, target, score, min(rank) AS round FROM ends2 WHERE rank <= 4 GROUP BY ALL ORDER BY round, score DESC, source, target LIMIT 500")
def q_topk_rounds(spark, sf):
    return evidence.rounds_by_rank(_links(spark, sf), 4, 500).select("source", "target", "score", F.col("round").cast("long").alias("round"))


@query(f"RECURSIVE {_LINKS};;SELECT source, target, score, round(1 - (row_number() OVER (ORDER BY score DESC, source, target) - 1) / (count(*) OVER () - 1), 9) AS evidence FROM links")
def q_percentile_rank(spark, sf):
    return evidence.percentile_rank(_links(spark, sf)).select("source", "target", "score", F.round("evidence", 9).alias("evidence"))


_MEMBERS = """mem AS (SELECT bin, block_id, bases, bases / sum(bases) OVER (PARTITION BY bin) AS share FROM (SELECT bin, block_id, least(visual_end, (bin + 1) * 50000) - greatest(visual_start, bin * 50000) AS bases FROM (
  SELECT *, unnest(range(visual_start // 50000, (visual_end - 1) // 50000 + 1)) AS bin FROM layout)))"""


@query(f"""RECURSIVE {_PROJECT}, cells AS (SELECT x // 50000 AS x_bin, y // 50000 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2), {_MEMBERS};;
SELECT source, target, round(raw, 6) AS raw_count, round(raw / ((a.visual_end - a.visual_start) / 1e6 * ((b.visual_end - b.visual_start) / 1e6)), 3) AS normalized_per_mb2 FROM (
  SELECT least(m.block_id, n.block_id) AS source, greatest(m.block_id, n.block_id) AS target, sum(count * m.share * n.share) AS raw FROM cells JOIN mem m ON m.bin = x_bin JOIN mem n ON n.bin = y_bin WHERE m.block_id <> n.block_id GROUP BY 1, 2)
JOIN layout a ON a.block_id = source JOIN layout b ON b.block_id = target""")
def q_hic_pairs(spark, sf):
    base = materialise(views.layout(spark, sf), "layout")
    cells = contacts.project(views.contact(spark, sf), base, 50_000)
    out = evidence.contact_links(cells, base, 50_000, rows=views.line_count(spark, sf))
    return out.select("source", "target", F.round("raw_count", 6).alias("raw_count"), F.round("normalized_per_mb2", 3).alias("normalized_per_mb2"))


@query("""RECURSIVE anchor AS (SELECT target_name AS target, aln_id AS anchor, target_start AS start, target_end AS "end" FROM paf WHERE block_len > 0);;
SELECT target, a, b, shared, floor(shared / greatest(la, lb) * 1e6) / 1e6 AS reciprocal, floor(shared / least(la, lb) * 1e6) / 1e6 AS shorter,
  CASE WHEN shared / greatest(la, lb) >= 0.5 THEN 'allele' WHEN shared / greatest(la, lb) <= 0.1 AND ((s1 < s2 AND e1 < e2) OR (s1 > s2 AND e1 > e2)) THEN 'boundary' ELSE 'partial' END AS kind FROM (
  SELECT a.target, a.anchor AS a, b.anchor AS b, least(a."end", b."end") - greatest(a.start, b.start) AS shared, a."end" - a.start AS la, b."end" - b.start AS lb, a.start AS s1, a."end" AS e1, b.start AS s2, b."end" AS e2
  FROM anchor a JOIN anchor b ON a.target = b.target AND a.anchor < b.anchor AND a.start < b."end" AND b.start < a."end")""")
def q_anchor_overlap(spark, sf):
    out = evidence.anchor_overlaps(_anchors(spark, sf), 10_000)
    return out.select("target", "a", "b", "shared", *[(F.floor(F.col(c) * 1e6) / 1e6).alias(c) for c in ("reciprocal", "shorter")], "kind")


def _anchors(spark, sf):
    return views.paf(spark, sf).filter("block_len > 0").select(F.col("target_name").alias("target"), F.col("aln_id").alias("anchor"), F.col("target_start").alias("start"), F.col("target_end").alias("end"))


@query("""RECURSIVE anchor AS (SELECT target_name AS target, aln_id AS anchor, target_start AS start, target_end AS "end" FROM paf WHERE block_len > 0);;
SELECT target, anchor, other, side, gap FROM (
  SELECT a.target, a.anchor, b.anchor AS other, 'after' AS side, b.start - a."end" AS gap, row_number() OVER (PARTITION BY a.target, a.anchor ORDER BY b.start, b.anchor) AS k FROM anchor a JOIN anchor b ON a.target = b.target AND b.start >= a."end"
  UNION ALL SELECT a.target, a.anchor, b.anchor, 'before', a.start - b."end", row_number() OVER (PARTITION BY a.target, a.anchor ORDER BY b."end" DESC, b.anchor DESC) FROM anchor a JOIN anchor b ON a.target = b.target AND b."end" <= a.start) WHERE k <= 4""")
def q_nearest_k(spark, sf):
    return evidence.nearest(_anchors(spark, sf), 4)


@query("""SELECT query, target, score, dominance FROM (SELECT query_name AS query, target_name AS target, CAST(sum(matches) AS BIGINT) AS score, round(sum(matches) / sum(sum(matches)) OVER (PARTITION BY query_name), 6) AS dominance,
  row_number() OVER (PARTITION BY query_name ORDER BY sum(matches) DESC, target_name) AS k FROM paf GROUP BY 1, 2) WHERE k = 1""")
def q_dominance(spark, sf):
    scores = views.paf(spark, sf).groupBy(F.col("query_name").alias("query"), F.col("target_name").alias("target")).agg(F.sum("matches").alias("score"))
    return evidence.dominance(scores).select("query", "target", "score", F.round("dominance", 6).alias("dominance"))


_WINDOWS = """win AS (SELECT block_id, 'l' AS side, visual_start AS s, least(visual_start + 10000, visual_end) AS e FROM layout UNION ALL SELECT block_id, 'r', greatest(visual_end - 10000, visual_start), visual_end FROM layout),
wpart AS (SELECT block_id, side, bin, (least(e, (bin + 1) * 5000) - greatest(s, bin * 5000)) / 5000 AS part FROM (SELECT *, unnest(range(s // 5000, (e - 1) // 5000 + 1)) AS bin FROM win)),
cells AS (SELECT x // 5000 AS x_bin, y // 5000 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2), mir AS (SELECT * FROM cells UNION ALL SELECT y_bin, x_bin, count FROM cells WHERE x_bin <> y_bin),
pr AS (SELECT DISTINCT least(source1, source2) * 2 AS source, greatest(source1, source2) * 2 AS target FROM contact WHERE source1 <> source2)"""


@query(f"""RECURSIVE {_PROJECT}, {_WINDOWS};;SELECT source, target, round(sum(CASE WHEN a.side = 'l' AND b.side = 'l' THEN v ELSE 0 END), 6) AS ll, round(sum(CASE WHEN a.side = 'l' AND b.side = 'r' THEN v ELSE 0 END), 6) AS lr,
  round(sum(CASE WHEN a.side = 'r' AND b.side = 'l' THEN v ELSE 0 END), 6) AS rl, round(sum(CASE WHEN a.side = 'r' AND b.side = 'r' THEN v ELSE 0 END), 6) AS rr
FROM (SELECT source, target, a, b, count * a.part * b.part AS v FROM pr JOIN wpart a ON a.block_id = source JOIN mir ON x_bin = a.bin JOIN wpart b ON b.block_id = target AND b.bin = y_bin) GROUP BY 1, 2""")
def q_quadrants(spark, sf):
    base = materialise(views.layout(spark, sf), "layout")
    pairs = views.contact(spark, sf).filter("source1 <> source2").select((F.least("source1", "source2") * 2).alias("source"), (F.greatest("source1", "source2") * 2).alias("target")).distinct()
    out = evidence.quadrants(contacts.project(views.contact(spark, sf), base, 5_000), base, pairs, 5_000, 10_000)
    return out.select("source", "target", *[F.round(c, 6).alias(c) for c in ("ll", "lr", "rl", "rr")])


_LINES = """lm AS (SELECT bin, block_id, bin * 10000 - visual_start AS at FROM (SELECT *, unnest(range(visual_start // 10000, (visual_end - 1) // 10000 + 1)) AS bin FROM layout)),
cells AS (SELECT x // 10000 AS x_bin, y // 10000 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2),
hit AS (SELECT a.block_id AS source, b.block_id AS target, count, a.at AS a, b.at AS b FROM cells JOIN lm a ON a.bin = x_bin JOIN lm b ON b.bin = y_bin WHERE a.block_id < b.block_id),
modes AS (SELECT source, target, line, mode, sum(count) AS weight FROM (SELECT source, target, count, '+' AS line, CAST(floor((b - a) / 10000) AS BIGINT) AS mode FROM hit UNION ALL SELECT source, target, count, '-', CAST(floor((b + a) / 10000) AS BIGINT) FROM hit) GROUP BY ALL)"""


@query(f"""RECURSIVE {_PROJECT}, {_LINES};;SELECT source, target, line, mode, weight, round(share, 6) AS share FROM (
  SELECT *, weight / sum(weight) OVER (PARTITION BY source, target, line) AS share, row_number() OVER (PARTITION BY source, target ORDER BY weight DESC, line, mode) AS k FROM modes) WHERE k = 1""")
def q_line_modes(spark, sf):
    base = materialise(views.layout(spark, sf), "layout")
    members = base.withColumn("bin", F.explode(F.expr("sequence(visual_start div 10000, (visual_end - 1) div 10000)"))).select("bin", "block_id", (F.col("bin") * 10000 - F.col("visual_start")).alias("at"))
    rows = views.line_count(spark, sf)
    modes = evidence.line_modes(contacts.project(views.contact(spark, sf), base, 10_000, rows=rows), members, 10_000, rows)
    return evidence.strongest_line(modes).select("source", "target", "line", "mode", "weight", F.round("share", 6).alias("share"))


@query("""RECURSIVE e AS (SELECT DISTINCT source1 AS a, source2 AS b FROM contact WHERE source1 < source2 AND count >= 25), q AS (SELECT DISTINCT source1 AS a, source2 AS b FROM contact WHERE source1 < source2 AND start1 < 20000);;
SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall FROM (SELECT (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM q)) AS tp,
  (SELECT count(*) FROM (SELECT * FROM q EXCEPT SELECT * FROM e)) AS fp, (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM q)) AS fn)""")
def q_pair_metrics(spark, sf):
    base = views.contact(spark, sf).filter("source1 < source2")
    side = lambda c: base.filter(c).select(F.col("source1").alias("a"), F.col("source2").alias("b"))
    out = evidence.pair_metrics(side("count >= 25"), side("start1 < 20000"))
    return out.select("true_positive", "false_positive", "false_negative", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""RECURSIVE r AS (SELECT l_returnflag AS flag, count(*) FILTER (l_quantity >= 40) AS k, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT *, k / n AS p, 1.959963984540054 * 1.959963984540054 AS zz FROM r);;
SELECT flag, k, n, round((p + zz / (2 * n)) / (1 + zz / n) - 1.959963984540054 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n), 9) AS low, round((p + zz / (2 * n)) / (1 + zz / n) + 1.959963984540054 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n), 9) AS high FROM c""")
def q_wilson(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum((F.col("l_quantity") >= 40).cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = evidence.wilson(F.col("k"), F.col("n"))
    return rows.select("flag", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("SELECT a.source_id, a.block_id AS a, b.block_id AS b, least(a.source_end, b.source_end) - greatest(a.source_start, b.source_start) AS shared FROM layout a JOIN layout b ON a.source_id = b.source_id AND a.block_id < b.block_id")
def q_occupancy(spark, sf):
    return evidence.occupancy_conflicts(views.layout(spark, sf))


@query("""SELECT object_id, lag(block_id) OVER (PARTITION BY object_id ORDER BY ord) AS left_id, block_id AS right_id, visual_start AS at FROM layout
  UNION ALL SELECT object_id, block_id, NULL, visual_end FROM (SELECT *, lead(block_id) OVER (PARTITION BY object_id ORDER BY ord) AS n FROM layout) WHERE n IS NULL""")
def q_boundaries(spark, sf):
    return evidence.boundaries(views.layout(spark, sf))


# graphs

@query("""RECURSIVE seg AS (SELECT p_partkey AS name FROM part UNION SELECT s_suppkey + 1000000 FROM supplier);;
SELECT name, block_id, object_id, count(*) OVER (PARTITION BY name) AS occurrences FROM seg JOIN layout ON name = source_id UNION ALL SELECT name, NULL, 'Unplaced', 0 FROM seg WHERE name NOT IN (SELECT source_id FROM layout)""")
def q_gfa_nodes(spark, sf):
    segments = views.contig(spark, sf).select(F.col("source_id").alias("name")).unionByName(table(spark, sf, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("name")))
    return assembly_graph.graph_nodes(segments, views.layout(spark, sf))


_UNIQUE = """ul AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN (from_segment, from_side) <= (to_segment, to_side) THEN (from_segment, from_side, to_segment, to_side) ELSE (to_segment, to_side, from_segment, from_side) END, overlap ORDER BY line_no) AS k FROM glink) WHERE k = 1)"""


@query(f"RECURSIVE {_UNIQUE}, one AS (SELECT source_id, min(block_id) AS block_id FROM layout GROUP BY 1 HAVING count(*) = 1);;SELECT line_no, from_segment, to_segment, overlap, a.block_id AS from_block, b.block_id AS to_block FROM ul JOIN one a ON a.source_id = from_segment JOIN one b ON b.source_id = to_segment")
def q_gfa_unique_links(spark, sf):
    out = assembly_graph.placed_links(assembly_graph.unique_links(views.glink(spark, sf)), views.layout(spark, sf))
    return out.select("line_no", "from_segment", "to_segment", "overlap", "from_block", "to_block")


@query("SELECT line_no, CASE WHEN overlap <> '*' AND bases % 2 = 0 THEN bases END AS from_overlap_bases FROM glink")
def q_gfa_overlap(spark, sf):
    links = views.glink(spark, sf)
    segments = views.contig(spark, sf).select(F.col("source_id").alias("name"), "length")
    sized = links.join(segments.withColumnRenamed("name", "from_segment"), "from_segment").withColumn("l1", F.col("length") - F.col("bases") - F.col("bases") % 2).drop("length")
    return assembly_graph.verified_overlap(sized, segments).select("line_no", "from_overlap_bases")


@query("SELECT object_id, block_id, next_id, gap FROM (SELECT object_id, block_id, lead(block_id) OVER w AS next_id, lead(visual_start) OVER w - visual_end AS gap FROM layout WINDOW w AS (PARTITION BY object_id ORDER BY visual_start)) WHERE next_id IS NOT NULL")
def q_adjacency(spark, sf):
    return assembly_graph.adjacency(views.layout(spark, sf))


@query("""RECURSIVE e AS (SELECT DISTINCT from_segment AS a, to_segment AS b FROM glink), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(node, comp) USING KEY (node) AS (SELECT DISTINCT a, a FROM d UNION SELECT d.b, min(cc.comp) FROM cc JOIN d ON d.a = cc.node JOIN recurring.cc AS r ON r.node = d.b WHERE cc.comp < r.comp GROUP BY d.b);;SELECT node, comp AS component FROM cc""")
def q_components(spark, sf):
    return graph.components(views.glink(spark, sf).select(F.col("from_segment").alias("a"), F.col("to_segment").alias("b")))


# statistics and sets

@query("""RECURSIVE v AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS k FROM lineitem), n AS (SELECT max(k) AS n FROM v), q AS (SELECT percent, greatest(1.0, least(n, percent * (n + 1) / 100)) AS pos, n FROM n, (VALUES (5::DOUBLE), (50::DOUBLE), (95::DOUBLE), (99.5::DOUBLE)) t(percent));;
SELECT percent, round(a.v + (pos - floor(pos)) * (b.v - a.v), 6) AS value FROM q JOIN v a ON a.k = floor(pos) JOIN v b ON b.k = least(floor(pos) + 1, n)""")
def q_percentile_legacy(spark, sf):
    out = stats.legacy_percentile(table(spark, sf, "lineitem"), "l_extendedprice", [5, 50, 95, 99.5])
    return out.select("percent", F.round("value", 6).alias("value"))


@query("""RECURSIVE m AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1);;SELECT l_suppkey, median, quantile_cont(abs(l_quantity - median), 0.5) AS mad FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1, 2""")
def q_mad(spark, sf):
    return stats.median_and_mad(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity")


@query(_project_sql("""SELECT x_bin, y_bin, count FROM (SELECT x // 5000 AS x_bin, y // 5000 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2) WHERE x_bin <> y_bin AND count > 0
  AND xor((least(x_bin, y_bin) * 73856093) & 4294967295, (greatest(x_bin, y_bin) * 19349663) & 4294967295) % 10 = 0"""))
def q_hash_sample(spark, sf):
    return stats.colour_sample(contacts.project(views.contact(spark, sf), views.layout(spark, sf), 5_000), 1_000)


@query("""SELECT DISTINCT l_partkey % 97 AS tile_x, l_suppkey % 89 AS tile_y FROM lineitem WHERE l_quantity > 30 EXCEPT SELECT DISTINCT l_partkey % 97, l_suppkey % 89 FROM lineitem WHERE l_linenumber = 1""")
def q_missing_tiles(spark, sf):
    keys = lambda c: table(spark, sf, "lineitem").filter(c).select((F.col("l_partkey") % 97).alias("tile_x"), (F.col("l_suppkey") % 89).alias("tile_y")).distinct()
    return keys("l_quantity > 30").join(keys("l_linenumber = 1"), ["tile_x", "tile_y"], "left_anti")


@query("""SELECT l_partkey, l_suppkey, preview, value FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY preview) AS k FROM (
  SELECT l_partkey, l_suppkey, 0 AS preview, max(l_quantity) AS value FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2 UNION ALL SELECT l_partkey, l_suppkey, 1, min(l_quantity) FROM lineitem GROUP BY 1, 2)) WHERE k = 1""")
def q_override(spark, sf):
    lines = table(spark, sf, "lineitem")
    sure = lines.filter("l_linenumber <= 3").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("value")).withColumn("preview", F.lit(0))
    shown = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("value")).withColumn("preview", F.lit(1))
    both = sure.unionByName(shown)
    return both.withColumn("k", F.row_number().over(Window.partitionBy("l_partkey", "l_suppkey").orderBy("preview"))).filter("k = 1").drop("k")


@query(_project_sql("SELECT x // 50000 AS x_bin, y // 50000 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2"))
def q_delta_batch(spark, sf):
    """Sums of partial sums over slices of the contacts equal the whole."""
    rows = contacts.projected(views.contact(spark, sf), views.layout(spark, sf))
    partial = rows.groupBy(F.expr("x div 1000 % 4").alias("slice"), F.expr("x div 50000").alias("x_bin"), F.expr("y div 50000").alias("y_bin")).agg(F.sum("share").alias("count"))
    return partial.groupBy("x_bin", "y_bin").agg(F.sum("count").alias("count"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_events_windows(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("bucket"), "n", "users", "total")


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def q_events_sessions(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("w")


# recommendations

@query(f"""RECURSIVE {_PROJECT}, {_WINDOWS}, quad AS (SELECT source, target, sum(CASE WHEN a.side = 'l' AND b.side = 'l' THEN v ELSE 0 END) AS ll, sum(CASE WHEN a.side = 'l' AND b.side = 'r' THEN v ELSE 0 END) AS lr,
  sum(CASE WHEN a.side = 'r' AND b.side = 'l' THEN v ELSE 0 END) AS rl, sum(CASE WHEN a.side = 'r' AND b.side = 'r' THEN v ELSE 0 END) AS rr
  FROM (SELECT source, target, a, b, count * a.part * b.part AS v FROM pr JOIN wpart a ON a.block_id = source JOIN mir ON x_bin = a.bin JOIN wpart b ON b.block_id = target AND b.bin = y_bin) GROUP BY 1, 2),
r AS (SELECT *, round(greatest(ll, lr, rl, rr), 6) AS m, round(ll + lr + rl + rr, 6) AS t FROM quad);;
SELECT source, target, CASE WHEN round(ll, 6) = m THEN 'll' WHEN round(lr, 6) = m THEN 'lr' WHEN round(rl, 6) = m THEN 'rl' ELSE 'rr' END AS ends, round(log2((m + 1) / ((t - m) / 3 + 1)), 4) AS score FROM r""")
def q_junction_scores(spark, sf):
    return recommend.junction_scores(q_quadrants(spark, sf)).withColumn("score", F.round("score", 4))


@query("""RECURSIVE loci AS (SELECT query_name, target_name, sum(block_len) AS bases, sum(matches) / sum(block_len) AS identity, sum(mapq * block_len) / sum(block_len) AS mapq, CAST(sum(matches) AS BIGINT) AS score, any_value(query_len) AS query_len FROM paf WHERE block_len > 0 GROUP BY 1, 2),
r AS (SELECT *, score / sum(score) OVER (PARTITION BY query_name) AS dominance, row_number() OVER (PARTITION BY query_name ORDER BY score DESC, target_name) AS k FROM loci);;
SELECT query_name, target_name, round(dominance, 6) AS dominance, round(least(1.0, bases / query_len), 6) AS coverage, CASE WHEN least(1.0, bases / query_len) < 0.05 THEN 'coverage' WHEN identity < 0.83 THEN 'identity' WHEN mapq < 10 THEN 'mapq' WHEN dominance < 0.1 THEN 'dominance' ELSE 'anchor' END AS status FROM r WHERE k = 1""")
def q_primary_anchor(spark, sf):
    base = views.paf(spark, sf).filter("block_len > 0")
    loci = evidence.locus_stats(base).drop("score").join(base.groupBy("query_name", "target_name").agg(F.sum("matches").alias("score")), ["query_name", "target_name"])
    out = recommend.primary_anchors(loci, base.select("query_name", "query_len").distinct(), 0.05, 0.83, 10, 0.1)
    return out.select("query_name", "target_name", F.round("dominance", 6).alias("dominance"), F.round("coverage", 6).alias("coverage"), "status")


@query(None)
def q_pair_matching(spark, sf):
    links = _links(spark, sf)
    return recommend.pair_groups(links.select((F.expr("source div 4 * 100 + target % 100")).alias("group"), F.col("source").alias("row"), F.col("target").alias("column"), F.col("score").cast("double").alias("score")))


@query(None)
def q_linkage_clusters(spark, sf):
    return recommend.linkage_clusters(_anchors(spark, sf))


@query("""RECURSIVE n AS (SELECT source_id, count(*) AS n FROM layout GROUP BY 1), s AS (SELECT l.*, row_number() OVER (PARTITION BY object_id ORDER BY ord) AS pos, n FROM layout l JOIN n USING (source_id)),
b AS (SELECT g.*, f.object_id AS fo, f.pos AS fp, f.orientation AS fr, f.n AS fn, t.object_id AS too, t.pos AS tp, t.orientation AS tr, t.n AS tn FROM glink g LEFT JOIN s f ON f.source_id = from_segment LEFT JOIN s t ON t.source_id = to_segment),
k AS (SELECT *, fo = too AND abs(fp - tp) = 1 AS near, CASE WHEN (fr = '-') = (from_side = 'start') THEN 'right' ELSE 'left' END AS fs, CASE WHEN (tr = '-') = (to_side = 'start') THEN 'right' ELSE 'left' END AS ts FROM b),
r AS (SELECT DISTINCT CASE WHEN fn > 1 OR tn > 1 THEN 3 WHEN fn IS NULL OR tn IS NULL THEN 2 WHEN near AND NOT (CASE WHEN fp < tp THEN fs = 'right' AND ts = 'left' ELSE fs = 'left' AND ts = 'right' END) THEN 0 WHEN NOT near AND fo = too THEN 1 END AS priority, line_no, from_segment, to_segment FROM k);;
SELECT CAST(priority AS INTEGER) AS priority, ['orientation-conflict', 'off-backbone', 'unplaced-neighbour', 'copy-ambiguity'][priority + 1] AS kind, line_no, from_segment, to_segment FROM r WHERE priority IS NOT NULL ORDER BY priority, line_no LIMIT 40""")
def q_curation_issues(spark, sf):
    return recommend.curation_issues(views.glink(spark, sf), views.layout(spark, sf))


@query("""RECURSIVE e AS (SELECT block_id, object_id, source_id, CASE WHEN source_id % 13 = 0 THEN CASE orientation WHEN '+' THEN '-' ELSE '+' END ELSE orientation END AS orientation FROM layout);;
SELECT l.object_id, count(DISTINCT l.block_id) AS blocks, count(DISTINCT l.source_id) AS sources FROM layout l JOIN e ON l.block_id = e.block_id WHERE l.orientation <> e.orientation GROUP BY 1""")
def q_history_impact(spark, sf):
    before = views.layout(spark, sf)
    after = before.withColumn("orientation", F.when(F.col("source_id") % 13 == 0, layout.flip(F.col("orientation"))).otherwise(F.col("orientation")))
    return recommend.layout_impact(before, after)


@query("""RECURSIVE v AS (SELECT *, NOT regexp_matches(object_id, '#[135]') AS shown, source_end - source_start AS len FROM layout);;
SELECT block_id, object_id, shown, CAST(sum(len + 100) OVER (ORDER BY NOT shown, object_id, source_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - len AS visual_start FROM v""")
def q_visibility(spark, sf):
    """Hidden objects move behind the shown ones, so that copies keep their shares."""
    base = views.layout(spark, sf).withColumn("shown", ~F.col("object_id").rlike("#[135]"))
    moved = base.drop("visual_start", "visual_end").withColumn("ord", F.col("ord") + F.when(F.col("shown"), 0).otherwise(1 << 40))
    return layout.with_visual(moved).select("block_id", "object_id", "shown", "visual_start")


@query("""SELECT tile_x, md5(string_agg(source_id || ':' || orientation || ':' || (visual_start - tile_x * 5000000), ',' ORDER BY visual_start)) AS fingerprint FROM (
  SELECT *, unnest(range(visual_start // 5000000, (visual_end - 1) // 5000000 + 1)) AS tile_x FROM layout) GROUP BY 1""")
def q_tile_fingerprint(spark, sf):
    cells = views.layout(spark, sf).withColumn("tile_x", F.explode(F.expr("sequence(visual_start div 5000000, (visual_end - 1) div 5000000)")))
    part = F.struct("visual_start", F.concat_ws(":", "source_id", "orientation", F.col("visual_start") - F.col("tile_x") * 5_000_000).alias("text"))
    return cells.groupBy("tile_x").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), ",").cast("binary")).alias("fingerprint"))


# further edits and evidence

@query("""RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ord) > 1 AND source_id % 9 = 0 AS cut FROM layout),
p AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY object_id ORDER BY ord ROWS UNBOUNDED PRECEDING) + 1 AS part FROM c);;
SELECT block_id, object_id || CASE WHEN part > 1 THEN '_d' || part ELSE '' END AS object_id, source_id, source_start, source_end, orientation, CASE WHEN cut THEN 0 ELSE gap_before END AS gap_before, ord FROM p""")
def q_edit_boundaries(spark, sf):
    return layout.add_boundaries(views.layout(spark, sf), F.col("source_id") % 9 == 0)


@query("""SELECT block_id * 2 AS block_id, object_id, source_id, source_start, source_end, orientation, gap_before, ord * 2 AS ord FROM layout""")
def q_edit_join(spark, sf):
    """Cutting blocks and deleting the new gaps gives the blocks back."""
    middle = F.when(F.col("source_id") % 7 == 0, F.expr("(visual_start + visual_end) div 2"))
    cut = layout.split_at(views.layout(spark, sf), F.coalesce(middle, F.lit(-1)), gap=0)
    return layout.join_split_runs(cut)


@query("""RECURSIVE q AS (SELECT DISTINCT l_orderkey * 7919 % 52000000 AS "at" FROM lineitem);;
SELECT "at", block_id, distance FROM (SELECT "at", block_id, abs(visual_start - "at") AS distance, row_number() OVER (PARTITION BY "at" ORDER BY abs(visual_start - "at"), visual_start, block_id) AS k FROM q JOIN layout ON visual_start BETWEEN "at" - 200000 AND "at" + 200000) WHERE k = 1""")
def q_nearest_boundary(spark, sf):
    positions = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 7919 % 52_000_000).alias("at")).distinct()
    return layout.nearest_boundary(views.layout(spark, sf), positions, 100_000, 200_000)


@query("""RECURSIVE src AS (SELECT 'ctg' || source_id AS name, length FROM contig WHERE source_id % 5 <> 4),
b AS (SELECT block_id, CASE source_id % 5 WHEN 1 THEN 'ctg' || source_id || ':101-' || (source_end + 100) WHEN 2 THEN 'ctg' || source_id || CASE WHEN side = 1 THEN '_d2' ELSE '' END ELSE 'ctg' || source_id END AS name, source_id, side, source_end // 2 AS half
  FROM (SELECT block_id * 2 + side AS block_id, source_id, source_end, side FROM (SELECT *, unnest(CASE WHEN source_id % 5 = 2 THEN [0, 1] ELSE [0] END) AS side FROM layout WHERE object_id <> '~copy')));;
SELECT block_id, CASE WHEN source_id % 5 <> 4 THEN 'ctg' || source_id END AS resolved, CASE source_id % 5 WHEN 4 THEN NULL WHEN 1 THEN 100 WHEN 2 THEN side * half ELSE 0 END AS "offset",
  CASE source_id % 5 WHEN 4 THEN 'missing' WHEN 1 THEN 'coordinates' WHEN 2 THEN 'pieces' ELSE 'exact' END AS how FROM b""")
def q_name_resolution(spark, sf):
    base = views.layout(spark, sf).filter("object_id <> '~copy'")
    kind = F.col("source_id") % 5
    halves = F.when(kind == 2, F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("s"), F.expr("source_end div 2").alias("e")), F.struct(F.lit(1).alias("side"), F.expr("source_end div 2").alias("s"), F.col("source_end").alias("e")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("s"), F.col("source_end").alias("e"))))
    parts = base.withColumn("p", F.explode(halves))
    name = F.concat(F.lit("ctg"), F.col("source_id").cast("string"), F.when(kind == 1, F.concat(F.lit(":101-"), (F.col("source_end") + 100).cast("string"))).when((kind == 2) & (F.col("p.side") == 1), "_d2").otherwise(""))
    named = parts.select((F.col("block_id") * 2 + F.col("p.side")).alias("block_id"), name.alias("source_id"), F.col("p.s").alias("source_start"), F.col("p.e").alias("source_end"))
    sources = views.contig(spark, sf).filter("source_id % 5 <> 4").select(F.concat(F.lit("ctg"), F.col("source_id").cast("string")).alias("name"), "length")
    return layout.resolve_names(named, sources)


@query(f"""RECURSIVE {_PROJECT}, {_LINES}, b AS (SELECT *, sum(weight) OVER (PARTITION BY source, target, line ORDER BY mode RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS band, sum(weight) OVER w AS total, min(mode) OVER w AS lo, max(mode) OVER w AS hi FROM modes WINDOW w AS (PARTITION BY source, target, line)),
k AS (SELECT *, row_number() OVER (PARTITION BY source, target, line ORDER BY band DESC, mode) AS k FROM b);;
SELECT source, target, line, mode, band, floor(band / (total * 3 / greatest(hi - lo + 1, 3)) * 1e4 + 0.5) / 1e4 AS enrichment FROM k WHERE k = 1""")
def q_line_bands(spark, sf):
    base = materialise(views.layout(spark, sf), "layout")
    members = base.withColumn("bin", F.explode(F.expr("sequence(visual_start div 10000, (visual_end - 1) div 10000)"))).select("bin", "block_id", (F.col("bin") * 10000 - F.col("visual_start")).alias("at"))
    rows = views.line_count(spark, sf)
    modes = evidence.line_modes(contacts.project(views.contact(spark, sf), base, 10_000, rows=rows), members, 10_000, rows)
    return evidence.band_scores(modes).withColumn("enrichment", F.floor(F.col("enrichment") * 1e4 + 0.5) / 1e4)


@query(f"""RECURSIVE {_PROJECT}, {_LINES};;SELECT source, target, line, weight, floor(effective * 1e4 + 0.5) / 1e4 AS effective, span, places FROM (
  SELECT source, target, line, sum(weight) AS weight, sum(weight) * sum(weight) / sum(weight * weight) AS effective, max(mode) - min(mode) + 1 AS span, count(DISTINCT mode) AS places FROM modes GROUP BY 1, 2, 3)""")
def q_line_distribution(spark, sf):
    base = materialise(views.layout(spark, sf), "layout")
    members = base.withColumn("bin", F.explode(F.expr("sequence(visual_start div 10000, (visual_end - 1) div 10000)"))).select("bin", "block_id", (F.col("bin") * 10000 - F.col("visual_start")).alias("at"))
    rows = views.line_count(spark, sf)
    modes = evidence.line_modes(contacts.project(views.contact(spark, sf), base, 10_000, rows=rows), members, 10_000, rows)
    return evidence.line_distribution(modes.withColumnRenamed("mode", "place")).withColumn("effective", F.floor(F.col("effective") * 1e4 + 0.5) / 1e4)


_TIERS = f"""{_LINKS}, lk AS (SELECT source * 2 AS source, target * 2 AS target, score FROM links), en AS (SELECT source AS selected, target AS partner, score FROM lk UNION ALL SELECT target, source, score FROM lk),
cf AS (SELECT DISTINCT a.block_id AS selected, c.block_id AS partner FROM layout a JOIN layout b ON a.source_id = b.source_id AND a.block_id <> b.block_id JOIN layout c ON c.object_id = b.object_id),
tp AS (SELECT * FROM (SELECT selected, partner, score, tier, row_number() OVER (PARTITION BY selected, tier ORDER BY score DESC, partner) AS rank FROM (
  SELECT en.*, CASE WHEN cf.partner IS NULL THEN 0 ELSE 1 END AS tier FROM en LEFT JOIN cf ON cf.selected = en.selected AND cf.partner = en.partner)) WHERE rank <= 4)"""


def _tiers(spark, sf):
    base = materialise(views.layout(spark, sf), "layout")
    selected = base.select(F.col("block_id").alias("selected"), "source_id")
    # objects that hold another placement of the selected block's source are taken
    taken = selected.join(base.select("object_id", "block_id", "source_id"), "source_id").filter("selected <> block_id").select("selected", "object_id").distinct()
    links = _links(spark, sf).select((F.col("source") * 2).alias("source"), (F.col("target") * 2).alias("target"), "score")
    return base, recommend.tiered_partners(links, selected.select("selected"), taken, 4, base)


@query(f"RECURSIVE {_TIERS};;SELECT selected, partner, score, tier, rank FROM tp")
def q_tiered_partners(spark, sf):
    return _tiers(spark, sf)[1]


@query(f"""RECURSIVE {_TIERS}, bd AS (SELECT object_id, lag(block_id) OVER (PARTITION BY object_id ORDER BY ord) AS left_id, block_id AS right_id FROM layout
  UNION ALL SELECT object_id, block_id, NULL FROM (SELECT *, lead(block_id) OVER (PARTITION BY object_id ORDER BY ord) AS n FROM layout) WHERE n IS NULL);;
SELECT DISTINCT selected, object_id, left_id, right_id, o AS orientation FROM tp JOIN bd ON partner = left_id OR partner = right_id CROSS JOIN (VALUES ('+'), ('-')) t(o) WHERE left_id IS DISTINCT FROM selected AND right_id IS DISTINCT FROM selected""")
def q_placement_candidates(spark, sf):
    base, partners = _tiers(spark, sf)
    return recommend.placement_candidates(partners, evidence.boundaries(base))


@query(f"""RECURSIVE {_PROJECT}, {_LINES}, t AS (SELECT source, target, line, sum(weight) AS weight FROM modes GROUP BY 1, 2, 3), u AS (SELECT source, target, max(CASE WHEN line = '+' THEN weight ELSE 0 END) AS w FROM t GROUP BY 1, 2),
b AS (SELECT source, target, line, mode, weight / sum(weight) OVER (PARTITION BY source, target, line) AS share, weight FROM modes);;
SELECT source, target, line, mode, weight FROM b WHERE share > 0.2 AND weight >= 60""")
def q_allele_lines(spark, sf):
    """Lines that hold more than a fifth of their orientation's contacts."""
    base = materialise(views.layout(spark, sf), "layout")
    members = base.withColumn("bin", F.explode(F.expr("sequence(visual_start div 10000, (visual_end - 1) div 10000)"))).select("bin", "block_id", (F.col("bin") * 10000 - F.col("visual_start")).alias("at"))
    rows = views.line_count(spark, sf)
    modes = evidence.line_modes(contacts.project(views.contact(spark, sf), base, 10_000, rows=rows), members, 10_000, rows)
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("source", "target", "line"))
    return modes.withColumn("share", share).filter("share > 0.2 AND weight >= 60").select("source", "target", "line", "mode", "weight")
