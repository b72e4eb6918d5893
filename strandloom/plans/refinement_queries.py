"""Queries of clustered levels, adaptive maps, Knight-Ruiz, allele lines and trims, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.storage import materialise, scratch_path, table
from strandloom.operators import adaptive, alleles, balance, contacts, knight_ruiz, layout, loci, navigation, placement, pyramid, reproject, trims
from strandloom.plans import views
from strandloom.plans.catalogue import _MEMBERS, _PROJECT, _project_sql, query
from strandloom.sources import ranged, tiles

#: Pixels of a part in the queries, few enough that small tables have several.
_PART = 5_000
_VIEW = (1_000_000, 4_000_000, 3_000_000, 6_000_000)
_CHAIN = [50_000, 10_000, 5_000, 1_000]


def _store(spark, sf, levels=(1_000,)):
    path, chroms = scratch_path(spark, "levels"), materialise(views.chrom(spark, sf), "chroms")
    for resolution, pixels in pyramid.build_levels(materialise(views.pixel(spark, sf), "pixels"), chroms, sorted(levels), 1_000).items():
        ranged.write_level(pixels, pyramid.bins(chroms, resolution), f"{path}/{resolution}", _PART)
    return path, chroms


@query(_project_sql(f"SELECT x // 10000 AS x_bin, y // 10000 AS y_bin, CAST(sum(share) AS DOUBLE) AS count FROM p WHERE x >= {_VIEW[0]} AND x < {_VIEW[1]} AND y >= {_VIEW[2]} AND y < {_VIEW[3]} GROUP BY 1, 2"))
def q_pushed_viewport(spark, sf):
    """A view of the map from the parts of the base level that its source ranges name."""
    path, chroms = _store(spark, sf)
    layout = materialise(views.layout(spark, sf), "layout")
    return contacts.project(ranged.read_view(spark, f"{path}/1000", layout, chroms, 1_000, _VIEW, _PART), layout, 10_000, _VIEW)


@query(_project_sql("SELECT x // 50000 AS x_bin, y // 50000 AS y_bin, CAST(sum(share) AS DOUBLE) AS count FROM p GROUP BY 1, 2"))
def q_adaptive_map(spark, sf):
    """The whole map through a pyramid that is split only where the layout needs it."""
    path, chroms = _store(spark, sf, _CHAIN)
    return adaptive.adaptive_map(ranged.level_reader(spark, path, _PART), chroms, materialise(views.layout(spark, sf), "layout"), _CHAIN, 50_000)[0]


_INDEX = 'idx AS (SELECT bin_id, chrom_id, start, "end", CAST(sum(n) OVER (ORDER BY bin_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS bin1_offset, n AS n_pixels FROM (SELECT b.bin_id, b.chrom_id, b.start, b."end", count(p.bin1_id) AS n FROM bins b LEFT JOIN pixel p ON p.bin1_id = b.bin_id GROUP BY ALL))'


@query("SELECT row_number() OVER (ORDER BY bin1_id) - 1 AS pixel, bin1_id FROM pixel")
def q_owner_rows(spark, sf):
    """The row of every pixel number, from the index alone."""
    pixels = materialise(views.pixel(spark, sf), "pixels")
    index = materialise(ranged.row_index(pixels, pyramid.bins(views.chrom(spark, sf), 1_000)), "index")
    return ranged.owner_rows(index, spark.range(pixels.count()).withColumnRenamed("id", "pixel"), 5_000)


@query(f"""RECURSIVE {_INDEX}, o AS (SELECT bin_id, bin1_offset FROM idx UNION ALL SELECT max(bin_id) + 1, CAST(sum(n_pixels) AS BIGINT) FROM idx),
d AS (SELECT bin_id, bin1_offset - CASE WHEN bin_id % 101 = 7 THEN 500 ELSE 0 END AS v FROM o WHERE bin_id % 97 <> 5), j AS (SELECT d.*, b.v AS before FROM d LEFT JOIN d b ON b.bin_id = d.bin_id - 1);;
SELECT 'gap' AS problem, bin_id FROM j WHERE bin_id > 0 AND before IS NULL UNION ALL SELECT 'falls', bin_id FROM j WHERE v < before UNION ALL SELECT 'range', bin_id FROM j WHERE v < 0""")
def q_offset_problems(spark, sf):
    """What a check finds in offsets of which some are lowered and some are missing."""
    pixels = materialise(views.pixel(spark, sf), "pixels")
    index = materialise(ranged.row_index(pixels, pyramid.bins(views.chrom(spark, sf), 1_000)), "index")
    size = index.agg(F.max("bin_id") + 1, F.sum("n_pixels")).first()  # two numbers
    offsets = index.select("bin_id", "bin1_offset").unionByName(spark.createDataFrame([(int(size[0]), int(size[1]))], "bin_id long, bin1_offset long"))
    damaged = offsets.filter("bin_id % 97 <> 5").withColumn("bin1_offset", F.col("bin1_offset") - F.when(F.col("bin_id") % 101 == 7, 500).otherwise(0))
    return ranged.offset_problems(damaged, int(size[0]), int(size[1]))


# balancing

_SIZES = """sz AS (SELECT source_id, length // 1000 AS k FROM contig), mx AS (SELECT least(a.k, b.k) AS i, greatest(a.k, b.k) AS j, CAST(sum(count) AS BIGINT) AS count FROM contact JOIN sz a ON a.source_id = source1 JOIN sz b ON b.source_id = source2 GROUP BY 1, 2),
sm AS (SELECT i, j, count FROM mx UNION ALL SELECT j, i, count FROM mx WHERE i <> j)"""


@query(f"RECURSIVE {_SIZES};;SELECT DISTINCT i AS bin_id, 1.0::DOUBLE AS marginal FROM sm")
def q_kr_small(spark, sf):
    """Contacts between contigs by size, balanced: each bin's marginal over the mean one of the matrix as it was, so that its total stays."""
    size = views.contig(spark, sf).select("source_id", F.expr("length div 1000").alias("k"))
    ends = [size.select(F.col("source_id").alias(f"source{n}"), F.col("k").alias(f"k{n}")) for n in (1, 2)]
    met = views.contact(spark, sf).join(ends[0], "source1").join(ends[1], "source2")
    pixels = materialise(met.groupBy(F.least("k1", "k2").alias("bin1_id"), F.greatest("k1", "k2").alias("bin2_id")).agg(F.sum("count").alias("count")), "pixels")
    weights = materialise(knight_ruiz.knight_ruiz_ladder(pixels)[0], "weights")
    mean = balance.row_sums(pixels).agg((F.sum("total") / F.count(F.lit(1))).alias("mean"))
    met = balance.multiply(pixels, weights).join(weights, "bin_id").crossJoin(F.broadcast(mean))  # one row
    return met.select("bin_id", F.round(F.col("value") * F.col("w") / F.col("mean"), 5).alias("marginal"))


# alleles by contacts: objects stand for long blocks, so that pairs have many windows

_RES = 8192
_OBJECTS = """ob AS (SELECT *, row_number() OVER (ORDER BY object_id) AS id, e - s AS len FROM (SELECT object_id, min(visual_start) AS s, max(visual_end) AS e FROM layout GROUP BY 1)),
cells AS (SELECT x // 8192 AS x_bin, y // 8192 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2),
bm AS (SELECT id, object_id, len, bin, (b - a) / 8192 AS w, (a + b) / 2 - s AS mid FROM (SELECT *, greatest(s, bin * 8192) AS a, least(e, (bin + 1) * 8192) AS b FROM (SELECT *, unnest(range(s // 8192, (e - 1) // 8192 + 1)) AS bin FROM ob WHERE len >= 5 * 8192)))"""
_PAIRS = f"""{_OBJECTS}, om AS (SELECT id, object_id, len, bin, w, CASE WHEN id % 2 = 0 THEN len - mid ELSE mid END AS "at" FROM bm),
pc0 AS (SELECT CASE WHEN x.id < y.id THEN x.id ELSE y.id END AS lft, CASE WHEN x.id < y.id THEN y.id ELSE x.id END AS rgt, CASE WHEN x.id < y.id THEN x.len ELSE y.len END AS ll, CASE WHEN x.id < y.id THEN y.len ELSE x.len END AS rl,
  CASE WHEN x.id < y.id THEN x."at" ELSE y."at" END AS la, CASE WHEN x.id < y.id THEN y."at" ELSE x."at" END AS ra, count * x.w * y.w AS weight FROM cells JOIN om x ON x.bin = x_bin JOIN om y ON y.bin = y_bin WHERE x.id <> y.id AND (x_bin <> y_bin OR x.id < y.id)),
pc1 AS (SELECT *, greatest(1, least(50, least(ll, rl) // 8192)) AS resolved, greatest(1, least(ll, rl) // greatest(1, least(50, least(ll, rl) // 8192))) AS width FROM pc0),
pc2 AS (SELECT *, CAST(greatest(1, ceil(ll / width)) AS BIGINT) AS nl, CAST(greatest(1, ceil(rl / width)) AS BIGINT) AS nr FROM pc1),
pc AS (SELECT *, CAST(least(greatest(floor(la / width), 0), nl - 1) AS BIGINT) AS l, CAST(least(greatest(floor(ra / width), 0), nr - 1) AS BIGINT) AS r, CAST(floor((ra - la) / width) AS BIGINT) AS plus, CAST(floor((ra + la) / width) AS BIGINT) AS minus,
  least(floor(CASE WHEN ll <= rl THEN la ELSE ra END / width), resolved - 1) AS s FROM pc2),
sup AS (SELECT lft, rgt, any_value(resolved) AS resolved, any_value(nl) AS nl, any_value(nr) AS nr, sum(weight) AS support, count(*) AS cells, count(DISTINCT s) AS covered FROM pc GROUP BY 1, 2),
ml AS (SELECT lft, rgt, l, sum(weight) AS w FROM pc GROUP BY ALL), mr AS (SELECT lft, rgt, r, sum(weight) AS w FROM pc GROUP BY ALL),
sp AS (SELECT lft, rgt, line, mode, sum(product) AS product, sum(weight) AS weight FROM (
  SELECT ml.lft, ml.rgt, '+' AS line, r - l AS mode, ml.w * mr.w AS product, 0::DOUBLE AS weight FROM ml JOIN mr ON ml.lft = mr.lft AND ml.rgt = mr.rgt UNION ALL SELECT ml.lft, ml.rgt, '-', r + l, ml.w * mr.w, 0 FROM ml JOIN mr ON ml.lft = mr.lft AND ml.rgt = mr.rgt
  UNION ALL SELECT lft, rgt, '+', plus, 0, weight FROM pc UNION ALL SELECT lft, rgt, '-', minus, 0, weight FROM pc) GROUP BY ALL),
bd AS (SELECT lft, rgt, line, mode, sum(product) AS product, sum(weight) AS observed FROM (SELECT lft, rgt, line, mode + o AS mode, product, weight FROM sp CROSS JOIN (VALUES (-1), (0), (1)) t(o)) GROUP BY ALL),
rt AS (SELECT bd.*, product / support AS expected, round(observed / support, 9) AS ratio, round(observed / greatest(product / support, 1.0), 9) AS enrichment, round((observed - product / support) / sqrt(greatest(product / support, 1.0)), 9) AS z FROM bd JOIN sup USING (lft, rgt)
  WHERE mode >= CASE WHEN line = '+' THEN 1 - nl ELSE 0 END AND mode <= CASE WHEN line = '+' THEN nr - 1 ELSE nl + nr - 2 END),
ln AS (SELECT * FROM rt WHERE z > 0 OR (z = 0 AND enrichment > 0) QUALIFY row_number() OVER (PARTITION BY lft, rgt ORDER BY z DESC, enrichment DESC, ratio DESC, line, mode) = 1),
nb AS (SELECT pc.lft, pc.rgt, l, r, nl, nr, weight FROM pc JOIN ln USING (lft, rgt) WHERE abs(CASE WHEN line = '+' THEN r - l ELSE r + l END - mode) <= 1),
sl AS (SELECT lft, rgt, count(*) / nl AS c, sum(w) * sum(w) / sum(w * w) / nl AS e, (max(l) - min(l) + 1) / nl AS s FROM (SELECT lft, rgt, nl, l, sum(weight) AS w FROM nb GROUP BY ALL) GROUP BY lft, rgt, nl),
sr AS (SELECT lft, rgt, count(*) / nr AS c, sum(w) * sum(w) / sum(w * w) / nr AS e, (max(r) - min(r) + 1) / nr AS s FROM (SELECT lft, rgt, nr, r, sum(weight) AS w FROM nb GROUP BY ALL) GROUP BY lft, rgt, nr),
hv AS (SELECT lft, rgt, max(CASE WHEN line = '+' THEN w END) AS plus, max(CASE WHEN line = '-' THEN w END) AS minus FROM (SELECT lft, rgt, line, mode, sum(weight) AS w FROM sp GROUP BY ALL) GROUP BY 1, 2),
al AS (SELECT sup.*, hv.plus / support AS parallel, hv.minus / support AS apart, line, mode, coalesce(observed, 0) AS observed, coalesce(round(expected, 9), 0) AS expected, coalesce(ratio, 0) AS ratio, coalesce(enrichment, 0) AS enrichment, coalesce(z, 0) AS z,
  coalesce(least(sl.c, sr.c), 0) AS coverage, coalesce(least(sl.e, sr.e), 0) AS effective, coalesce(least(sl.s, sr.s), 0) AS span FROM sup JOIN hv USING (lft, rgt) LEFT JOIN ln USING (lft, rgt) LEFT JOIN sl USING (lft, rgt) LEFT JOIN sr USING (lft, rgt)),
ev AS (SELECT *, greatest(parallel, apart) > 0.2 AS conc, observed >= 5 AND enrichment >= 1.1 AS heavy FROM al)"""


def _objects(spark, sf):
    base = materialise(views.layout(spark, sf), "layout")
    spans = base.groupBy("object_id").agg(F.min("visual_start").alias("visual_start"), F.max("visual_end").alias("visual_end"))
    ids = spans.withColumn("block_id", F.row_number().over(Window.orderBy("object_id")).cast("long"))  # a row for each object
    blocks = ids.select("block_id", "object_id", F.col("object_id").alias("source_id"), F.lit(0).cast("long").alias("source_start"), (F.col("visual_end") - F.col("visual_start")).alias("source_end"), F.when(F.col("block_id") % 2 == 0, "-").otherwise("+").alias("orientation"), "visual_start", "visual_end")
    return base, materialise(blocks, "objects"), materialise(contacts.project(views.contact(spark, sf), base, _RES), "cells")


def _r(*names):
    return [F.round(c, 6).alias(c) for c in names]


@query(f"""RECURSIVE {_PROJECT}, {_PAIRS};;SELECT lft AS "left", rgt AS "right", round(support, 6) AS support, cells, CAST(resolved AS BIGINT) AS resolved, covered, round(greatest(parallel, apart), 6) AS concordance, CASE WHEN conc THEN CASE WHEN parallel >= apart THEN '+' ELSE '-' END ELSE line END AS direction,
  CASE WHEN conc THEN 'concordance' ELSE 'trans-line' END AS model, line, mode, round(observed, 6) AS observed, round(expected, 6) AS expected, round(ratio, 6) AS ratio, round(enrichment, 6) AS enrichment, round(z, 6) AS z, round(coverage, 6) AS coverage, round(effective, 6) AS effective, round(span, 6) AS span,
  CASE WHEN heavy AND z >= 2.5 AND coverage >= 0.2 AND effective >= 0.1 AND span >= 0.2 THEN 'high' ELSE 'supported' END AS tier
FROM ev WHERE support >= 20 AND cells >= 3 AND covered >= greatest(3, ceil(resolved * 0.1)) AND (conc OR (heavy AND z >= 1 AND coverage >= 0.1 AND effective >= 0 AND span >= 0.1))""")
def q_allele_pairs(spark, sf):
    """Pairs of objects by the line of their contacts, with its significance and tier."""
    _, blocks, cells = _objects(spark, sf)
    out = alleles.allele_pairs(cells, blocks, _RES, {"enrichment": 1.1, "z": 1.0}, {"z": 2.5})
    return out.select("left", "right", *_r("support"), "cells", "resolved", "covered", *_r("concordance"), "direction", "model", "line", "mode", *_r("observed", "expected", "ratio", "enrichment", "z", "coverage", "effective", "span"), "tier")


_TRANS = f"""{_OBJECTS}, tc AS (SELECT lft, rgt, n, CAST(least(floor(la * n), n - 1) AS BIGINT) AS l, CAST(least(floor(ra * n), n - 1) AS BIGINT) AS r, sum(weight) AS w FROM (
  SELECT CASE WHEN x.object_id < y.object_id THEN x.object_id ELSE y.object_id END AS lft, CASE WHEN x.object_id < y.object_id THEN y.object_id ELSE x.object_id END AS rgt, least(50, least(x.len, y.len) // 8192) AS n,
    CASE WHEN x.object_id < y.object_id THEN x.mid / x.len ELSE y.mid / y.len END AS la, CASE WHEN x.object_id < y.object_id THEN y.mid / y.len ELSE x.mid / x.len END AS ra, count * x.w * y.w AS weight FROM cells JOIN bm x ON x.bin = x_bin JOIN bm y ON y.bin = y_bin WHERE x.id <> y.id) WHERE n >= 5 GROUP BY ALL),
tw AS (SELECT lft, rgt, n, sum(w) AS support, count(DISTINCT l) AS cl, count(DISTINCT r) AS cr FROM tc GROUP BY ALL),
tm AS (SELECT lft, rgt, line, mode, sum(w) AS weight, sum(w) * sum(w) / sum(w * w) AS effective FROM (SELECT *, '+' AS line, r - l AS mode FROM tc UNION ALL SELECT *, '-', r + l FROM tc) GROUP BY ALL),
tr AS (SELECT *, weight / support AS ratio, chances / (n * n) AS expected, weight / support - chances / (n * n) AS excess, weight / support / (chances / (n * n)) AS enrichment FROM (SELECT tm.*, n, support, cl, cr, n - abs(CASE WHEN line = '+' THEN mode ELSE mode - (n - 1) END) AS chances FROM tm JOIN tw USING (lft, rgt))
  WHERE chances >= ceil(n * 0.75) AND effective >= greatest(3.0, chances * 0.05)),
tl AS (SELECT lft, rgt, line, mode, n, support, ratio, expected, enrichment, excess, effective FROM (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY lft, rgt ORDER BY round(excess * sqrt(effective), 9) DESC, round(excess, 9) DESC, round(enrichment, 9) DESC, line, mode) = 1)
  WHERE support >= 100 AND cl >= ceil(n * 0.3) AND cr >= ceil(n * 0.3) AND enrichment >= 1.3 AND excess >= 0.01)"""
_LEAST = {"coverage": 0.3, "effective": 0.05, "excess": 0.01}


@query(f"""RECURSIVE {_PROJECT}, {_TRANS};;SELECT lft AS "left", rgt AS "right", line, mode, n AS windows, round(support, 6) AS support, round(ratio, 6) AS ratio, round(expected, 6) AS expected, round(enrichment, 6) AS enrichment, round(excess, 6) AS excess, round(effective, 6) AS effective FROM tl""")
def q_object_lines(spark, sf):
    """Lines between objects."""
    base, _, cells = _objects(spark, sf)
    return alleles.object_lines(cells, base, _RES, _LEAST).select("left", "right", "line", "mode", "windows", *_r("support", "ratio", "expected", "enrichment", "excess", "effective"))


@query(f"""RECURSIVE {_PROJECT}, {_TRANS}, pb AS (SELECT block_id, l.object_id, l.visual_start - s AS a, l.visual_end - s AS b, len FROM layout l JOIN ob USING (object_id)),
wy AS (SELECT lft, rgt, line, mode, n, lft AS here, rgt AS there, 1 AS sg FROM tl UNION ALL SELECT lft, rgt, line, mode, n, rgt, lft, -1 FROM tl),
mv AS (SELECT lft, rgt, there, block_id, CASE WHEN line = '+' THEN a / len * n + sg * mode ELSE mode - b / len * n END - 1 AS f, CASE WHEN line = '+' THEN b / len * n + sg * mode ELSE mode - a / len * n END + 1 AS t FROM wy JOIN pb ON here = object_id WHERE block_id % 3 = 0),
ot AS (SELECT lft, rgt, there, block_id AS partner, a / len * n AS f, b / len * n AS t FROM wy JOIN pb ON there = object_id);;
SELECT mv.block_id AS block, partner, mv.lft AS "left", mv.rgt AS "right", round(least(mv.t, ot.t) - greatest(mv.f, ot.f), 6) AS overlap, round(abs((ot.f + ot.t) / 2 - (mv.f + mv.t) / 2), 6) AS distance
FROM mv JOIN ot ON mv.lft = ot.lft AND mv.rgt = ot.rgt AND mv.there = ot.there AND mv.f < ot.t AND ot.f < mv.t WHERE round(least(mv.t, ot.t) - greatest(mv.f, ot.f), 6) > 0""")
def q_line_partners(spark, sf):
    """Blocks that the lines between objects bring together with every third block."""
    base, _, cells = _objects(spark, sf)
    lines = materialise(alleles.object_lines(cells, base, _RES, _LEAST), "object_lines")
    out = alleles.line_partners(lines, base, base.filter("block_id % 3 = 0"))
    return out.select("block", "partner", "left", "right", *_r("overlap", "distance")).filter("overlap > 0")


# overlaps of an assembly graph: links between neighbours of the layout, of every kind that a join can meet

_ALINK = """nbr AS (SELECT *, ls % 11 AS h, CASE WHEN lo = '-' THEN 'start' ELSE 'end' END AS a, CASE WHEN ro = '-' THEN 'end' ELSE 'start' END AS b FROM (
  SELECT block_id AS right_id, source_id AS rs, orientation AS ro, lag(source_id) OVER w AS ls, lag(orientation) OVER w AS lo FROM layout WINDOW w AS (PARTITION BY object_id ORDER BY ord)) WHERE ls IS NOT NULL),
alink AS (SELECT right_id * 10 AS line_no, ls AS f, CASE WHEN h = 2 THEN CASE a WHEN 'end' THEN 'start' ELSE 'end' END ELSE a END AS fs, rs AS t, b AS ts, CASE h WHEN 1 THEN '*' WHEN 2 THEN '10M' WHEN 3 THEN '40M' WHEN 4 THEN '10M' WHEN 5 THEN '5M1I3M' WHEN 6 THEN '99999999M' ELSE CASE WHEN rs % 2 = 0 THEN '120M' ELSE '100M20=' END END AS overlap, h = 3 AS verified FROM nbr WHERE h > 0
  UNION ALL SELECT right_id * 10 + 1, rs, b, ls, a, '30M10=5M', true FROM nbr WHERE h = 3 UNION ALL SELECT right_id * 10 + 1, ls, a, rs, b, '12M', false FROM nbr WHERE h = 4),
lk AS (SELECT f AS ls, fs, t AS rs, ts, line_no, overlap, verified, true AS fwd FROM alink UNION ALL SELECT t, ts, f, fs, line_no, overlap, verified, false FROM alink WHERE NOT (f = t AND fs = ts)),
sel AS (SELECT *, object_id || ':' || sum(CASE WHEN source_id % 7 < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY object_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS grp FROM layout QUALIFY source_id % 7 >= 2),
gr AS (SELECT s.*, lag(block_id) OVER w AS left_id, lag(source_id) OVER w AS ls, lag(orientation) OVER w AS lo FROM sel s WINDOW w AS (PARTITION BY grp ORDER BY ord)),
jn AS (SELECT g.block_id, grp, source_end - source_start AS len, count(line_no) AS between_n, count(*) FILTER (fit) AS fit_n, count(*) FILTER (fit AND fwd) AS ahead, count(*) FILTER (fit AND verified) AS sure, min(CASE WHEN fit THEN {'n': line_no, 'o': overlap} END) AS any_link, min(CASE WHEN fit AND NOT fwd THEN {'n': line_no, 'o': overlap} END) AS back FROM (
  SELECT gr.*, lk.line_no, lk.overlap, lk.fwd, lk.verified, coalesce(lk.fs = CASE WHEN lo = '-' THEN 'start' ELSE 'end' END AND lk.ts = CASE WHEN orientation = '-' THEN 'end' ELSE 'start' END, false) AS fit FROM gr LEFT JOIN lk ON lk.ls = gr.ls AND lk.rs = gr.source_id WHERE left_id IS NOT NULL) g GROUP BY ALL),
jp AS (SELECT *, fit_n = 2 AND ahead = 1 AND sure = 2 AS mutual, CASE WHEN fit_n = 1 THEN any_link WHEN fit_n = 2 AND ahead = 1 AND sure = 2 THEN back END AS link FROM jn),
jt AS (SELECT *, CASE WHEN link IS NULL THEN 0 WHEN regexp_full_match(link.o, '([0-9]+[M=])+') THEN list_sum([CAST(x AS BIGINT) FOR x IN regexp_extract_all(link.o, '([0-9]+)[M=]', 1)]) END AS trim FROM jp),
jr AS (SELECT *, CASE WHEN fit_n > 1 AND NOT mutual THEN 'several-overlaps' WHEN fit_n = 0 AND between_n > 0 THEN 'orientation-conflict' WHEN trim IS NULL THEN 'overlap-not-exact' WHEN trim >= len THEN 'overlap-too-long' END AS reason FROM jt),
gd AS (SELECT grp, coalesce(f, 0) = 0 AS done FROM (SELECT DISTINCT grp FROM sel) LEFT JOIN (SELECT grp, count(reason) AS f FROM jr GROUP BY 1) USING (grp)),
tm AS (SELECT block_id, link.n AS line_no, link.o AS overlap, CAST(trim AS BIGINT) AS trim FROM jr JOIN gd USING (grp) WHERE done)"""


def _graph(spark, sf):
    """The layout, links of every kind between its neighbours, and groups of neighbours to join."""
    base = materialise(views.layout(spark, sf).drop("visual_start", "visual_end"), "layout")
    w = Window.partitionBy("object_id").orderBy("ord")
    pairs = base.select(F.col("block_id").alias("right_id"), F.col("source_id").alias("rs"), F.col("orientation").alias("ro"), F.lag("source_id").over(w).alias("ls"), F.lag("orientation").over(w).alias("lo")).filter("ls IS NOT NULL").withColumn("h", F.col("ls") % 11)
    a, b, h = F.when(F.col("lo") == "-", "start").otherwise("end"), F.when(F.col("ro") == "-", "end").otherwise("start"), F.col("h")
    link = lambda no, f, fs, t, ts, overlap, verified: F.struct((F.col("right_id") * 10 + no).alias("line_no"), F.col(f).alias("from_segment"), fs.alias("from_side"), F.col(t).alias("to_segment"), ts.alias("to_side"), overlap.alias("overlap"), F.lit(verified).alias("verified"))
    ahead = lambda overlap, no=0, side=a, sure=False: link(no, "ls", side, "rs", b, F.lit(overlap) if isinstance(overlap, str) else overlap, sure)
    usual = F.when(F.col("rs") % 2 == 0, "120M").otherwise("100M20=")
    kinds = F.when(h == 1, F.array(ahead("*"))).when(h == 2, F.array(ahead("10M", side=F.when(a == "end", "start").otherwise("end")))).when(h == 3, F.array(ahead("40M", sure=True), link(1, "rs", b, "ls", a, F.lit("30M10=5M"), True)))
    kinds = kinds.when(h == 4, F.array(ahead("10M"), ahead("12M", 1))).when(h == 5, F.array(ahead("5M1I3M"))).when(h == 6, F.array(ahead("99999999M"))).otherwise(F.array(ahead(usual)))
    links = pairs.filter("h > 0").select(F.explode(kinds).alias("k")).select("k.*")
    run = F.sum((F.col("source_id") % 7 < 2).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    selected = base.withColumn("group", F.concat_ws(":", "object_id", run.cast("string"))).filter("source_id % 7 >= 2").select("block_id", "group")
    return base, materialise(links, "links"), materialise(selected, "selected")


@query(f"RECURSIVE {_ALINK};;SELECT grp AS \"group\", block_id AS right_id, CASE WHEN link IS NOT NULL THEN link.n END AS line_no, CAST(trim AS BIGINT) AS trim, reason, done FROM jr JOIN gd USING (grp)")
def q_trim_plan(spark, sf):
    """How each pair of selected neighbours would be joined along the graph, and whether its group is."""
    return trims.plan_blocks(*_graph(spark, sf)).select("group", "right_id", "line_no", "trim", "reason", "done")


@query(f"""RECURSIVE {_ALINK};;SELECT l.block_id, l.object_id, source_id, CASE WHEN orientation = '-' THEN source_start ELSE source_start + coalesce(trim, 0) END AS source_start, CASE WHEN orientation = '-' THEN source_end - coalesce(trim, 0) ELSE source_end END AS source_end, orientation,
  CASE WHEN tm.block_id IS NOT NULL THEN 0 ELSE gap_before END AS gap_before, ord, u.grp AS assembly_block FROM layout l LEFT JOIN tm USING (block_id) LEFT JOIN (SELECT block_id, grp FROM sel JOIN gd USING (grp) WHERE done AND grp IN (SELECT grp FROM jr)) u USING (block_id)""")
def q_trim_create(spark, sf):
    """The layout after the groups that can be joined are."""
    return trims.create_blocks(*_graph(spark, sf))[0]


@query(f"RECURSIVE {_ALINK};;SELECT block_id, line_no, overlap, trim AS trimmed, source_start AS original_start, source_end AS original_end FROM tm JOIN layout USING (block_id) WHERE trim > 0")
def q_trim_ledger(spark, sf):
    """What the joins have trimmed."""
    return trims.create_blocks(*_graph(spark, sf))[1]


@query("SELECT block_id, object_id, source_id, source_start, source_end, orientation, gap_before, ord FROM layout")
def q_trim_dissolve(spark, sf):
    """Joining and parting again gives the layout back."""
    base, links, selected = _graph(spark, sf)
    joined, ledger = (materialise(x, "joined") for x in trims.create_blocks(base, links, selected))
    return trims.dissolve_blocks(joined, ledger, base.select("block_id"))[0].drop("assembly_block")


@query("SELECT block_id * 2 AS block_id, object_id, source_id, source_start, source_end, orientation, gap_before, ord * 2 AS ord FROM layout")
def q_edit_delete_gaps(spark, sf):
    """Cutting every other block with a gap and deleting the gaps gives the blocks back, without a trim along their graph's self-links."""
    middle = F.when(F.col("source_id") % 2 == 0, F.expr("(visual_start + visual_end) div 2"))
    cut = materialise(layout.split_at(views.layout(spark, sf), F.coalesce(middle, F.lit(-1))), "cut")
    links = cut.select(F.col("block_id").alias("line_no"), F.col("source_id").alias("from_segment"), F.lit("end").alias("from_side"), F.col("source_id").alias("to_segment"), F.lit("start").alias("to_side"), F.lit("9M").alias("overlap"), F.lit(True).alias("verified"))
    selected = cut.select("block_id", F.expr("block_id div 2").alias("group"))
    return trims.delete_gaps(cut, links, selected)[0]


@query(_project_sql("""SELECT least(mx, my) AS x_bin, greatest(mx, my) AS y_bin, CAST(sum(count) AS DOUBLE) AS count FROM (SELECT x // 5000 AS x_bin, y // 5000 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2)
JOIN (SELECT bin, CAST(floor(to_ / 5000) AS BIGINT) AS mx FROM (SELECT DISTINCT b.bin, CASE WHEN n.orientation <> o.orientation THEN n.visual_start + o.visual_end - (bin * 5000 + 2500) - 1 ELSE n.visual_start + bin * 5000 + 2500 - o.visual_start END AS to_ FROM (SELECT unnest(range(0, (SELECT max(visual_end) // 5000 + 1 FROM layout))) AS bin) b JOIN layout o ON bin * 5000 + 2500 >= o.visual_start AND bin * 5000 + 2500 < o.visual_end
  JOIN (SELECT block_id, CASE WHEN source_id % 3 = 1 THEN CASE orientation WHEN '+' THEN '-' ELSE '+' END ELSE orientation END AS orientation, CAST(sum(source_end - source_start + gap_before) OVER (ORDER BY CASE WHEN object_id = 'Brand#23' THEN 0 ELSE 1 END, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) - (source_end - source_start) AS visual_start FROM layout) n USING (block_id))) a ON a.bin = x_bin
JOIN (SELECT bin, CAST(floor(to_ / 5000) AS BIGINT) AS my FROM (SELECT DISTINCT b.bin, CASE WHEN n.orientation <> o.orientation THEN n.visual_start + o.visual_end - (bin * 5000 + 2500) - 1 ELSE n.visual_start + bin * 5000 + 2500 - o.visual_start END AS to_ FROM (SELECT unnest(range(0, (SELECT max(visual_end) // 5000 + 1 FROM layout))) AS bin) b JOIN layout o ON bin * 5000 + 2500 >= o.visual_start AND bin * 5000 + 2500 < o.visual_end
  JOIN (SELECT block_id, CASE WHEN source_id % 3 = 1 THEN CASE orientation WHEN '+' THEN '-' ELSE '+' END ELSE orientation END AS orientation, CAST(sum(source_end - source_start + gap_before) OVER (ORDER BY CASE WHEN object_id = 'Brand#23' THEN 0 ELSE 1 END, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) - (source_end - source_start) AS visual_start FROM layout) n USING (block_id))) c ON c.bin = y_bin GROUP BY 1, 2"""))
def q_reprojected_map(spark, sf):
    """A map whose cells follow an object that is moved to the front and blocks that are turned."""
    before = materialise(views.layout(spark, sf), "layout")
    moved = layout.move_object_first(before, "Brand#23").withColumn("orientation", F.when(F.col("source_id") % 3 == 1, layout.flip(F.col("orientation"))).otherwise(F.col("orientation")))
    out = reproject.reproject(contacts.project(views.contact(spark, sf), before, 5_000), before, materialise(layout.with_visual(moved), "moved"), 5_000)
    return out.withColumn("count", F.col("count").cast("double"))


# loci on a reference: anchors, alleles, occupied places, masks

_LOCI = """nd AS (SELECT source_id || ':' || source_start || '-' || source_end AS node, source_id, source_end - source_start AS len, count(*) AS blocks FROM layout GROUP BY source_id, source_start, source_end),
ob AS (SELECT node, len, target_name AS target, CAST(target_start AS DOUBLE) AS s, CAST(target_end AS DOUBLE) AS e, query_start AS qs, query_end AS qe, strand, least(1.0, matches / block_len) AS identity, mapq, query_end - query_start AS bases FROM paf JOIN nd ON query_name = source_id WHERE query_end > query_start AND block_len > 0),
cl AS (SELECT *, sum(fresh) OVER (PARTITION BY node, target ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS locus FROM (SELECT *, CASE WHEN max(e) OVER (PARTITION BY node, target ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 20000 >= s THEN 0 ELSE 1 END AS fresh FROM ob)),
uq AS (SELECT node, target, locus, min(qs) AS s, max(qe) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY node, target, locus ORDER BY qs, qe ROWS UNBOUNDED PRECEDING) AS i FROM (
  SELECT *, CASE WHEN max(qe) OVER (PARTITION BY node, target, locus ORDER BY qs, qe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= qs THEN 0 ELSE 1 END AS f FROM cl)) GROUP BY node, target, locus, i),
sq AS (SELECT node, target, locus, sum(e - s) AS span FROM uq GROUP BY ALL),
lt AS (SELECT c.node, c.target, c.locus, any_value(len) AS len, min(s) AS s, any_value(span) AS span, any_value(span) / any_value(len) AS coverage, sum(identity * bases) / sum(bases) AS identity, sum(mapq * bases) / sum(bases) AS mapq, coalesce(sum(bases) FILTER (strand = '-'), 0) AS minus, sum(bases) AS bases FROM cl c JOIN sq USING (node, target, locus) GROUP BY ALL),
ls AS (SELECT *, span * identity AS score, CASE WHEN minus * 2 > bases THEN '-' ELSE '+' END AS strand, CASE WHEN minus * 2 > bases THEN minus ELSE bases - minus END / bases AS strand_share FROM lt),
bl AS (SELECT * FROM (SELECT *, score / sum(score) OVER (PARTITION BY node) AS dominance, row_number() OVER (PARTITION BY node ORDER BY round(score, 6) DESC, round(coverage, 9) DESC, target, s) AS k FROM ls) WHERE k = 1),
ol AS (SELECT o.node, o.target, o.locus, o.s, o.e, b.target AS bt, b.locus AS bl FROM uq o JOIN bl b ON b.node = o.node WHERE dominance < 0.06 AND NOT (o.target = b.target AND o.locus = b.locus)),
sh AS (SELECT ol.node, ol.target, ol.locus, sum(greatest(0, least(ol.e, w.e) - greatest(ol.s, w.s))) AS shared FROM ol JOIN uq w ON w.node = ol.node AND w.target = bt AND w.locus = bl GROUP BY ALL),
mk AS (SELECT node, CASE WHEN max(part) <= 0.1 THEN 'split' WHEN max(part) >= 0.5 THEN 'repetitive' ELSE 'mixed' END AS kind FROM (SELECT sh.node, shared / least(o.span, b.span) AS part FROM sh JOIN sq o ON o.node = sh.node AND o.target = sh.target AND o.locus = sh.locus JOIN bl b ON b.node = sh.node) GROUP BY 1),
an AS (SELECT nd.node, blocks, target, locus, coverage, identity, mapq, strand, strand_share, score, dominance, CASE WHEN target IS NULL THEN 'no-paf-alignment' WHEN dominance < 0.06 THEN 'multi-locus-' || coalesce(kind, 'mixed') WHEN coverage < 0.05 THEN 'low-query-coverage' WHEN identity < 0.83 THEN 'low-identity' WHEN mapq < 20 THEN 'low-mapq' ELSE 'anchor' END AS status FROM nd LEFT JOIN bl USING (node) LEFT JOIN mk USING (node)),
ti AS (SELECT node, target, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY node, target ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (
  SELECT c.*, CASE WHEN max(c.e) OVER (PARTITION BY c.node, c.target ORDER BY c.s, c.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= c.s THEN 0 ELSE 1 END AS f FROM cl c JOIN an ON an.node = c.node AND an.target = c.target AND an.locus = c.locus WHERE status = 'anchor')) GROUP BY node, target, i),
sn AS (SELECT node, target, sum(e - s) AS span, min(s) AS s, max(e) AS e FROM ti GROUP BY ALL),
ov AS (SELECT a.target, a.node AS a, b.node AS b, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS overlap FROM ti a JOIN ti b ON a.target = b.target AND a.node < b.node AND a.s < b.e AND b.s < a.e GROUP BY ALL),
ed AS (SELECT ov.*, overlap / least(x.span, y.span) AS shorter, overlap / greatest(x.span, y.span) AS reciprocal, CASE WHEN overlap / greatest(x.span, y.span) >= 0.3 THEN 'allele' WHEN overlap / greatest(x.span, y.span) <= 0.2 AND ((x.s < y.s AND x.e < y.e) OR (y.s < x.s AND y.e < x.e)) THEN 'boundary-overlap' ELSE 'partial-overlap' END AS kind
  FROM ov JOIN sn x ON x.target = ov.target AND x.node = a JOIN sn y ON y.target = ov.target AND y.node = b WHERE overlap / least(x.span, y.span) >= 0.1)"""
_ANCHORS = {"coverage": 0.05, "identity": 0.83, "mapq": 20.0, "dominance": 0.06}


def _loci(spark, sf):
    """Nodes, anchors and their target intervals."""
    base = materialise(views.layout(spark, sf), "layout")
    nodes = materialise(loci.source_nodes(base), "nodes")
    seen = materialise(loci.clustered(loci.observations(nodes, views.paf(spark, sf, ids=False).filter("query_end > query_start")), 20_000), "observations")
    found = materialise(loci.anchors(seen, loci.locus_table(seen), nodes, _ANCHORS), "anchors")
    return base, found, materialise(loci.anchor_intervals(seen, found), "intervals")


@query(f"RECURSIVE {_LOCI};;SELECT node, blocks, target, round(coverage, 6) AS coverage, round(identity, 6) AS identity, round(mapq, 6) AS mapq, strand, round(strand_share, 6) AS strand_share, round(dominance, 6) AS dominance, status FROM an")
def q_locus_anchors(spark, sf):
    """Each source interval's best locus, and whether it is an anchor or why not."""
    found = _loci(spark, sf)[1]
    return found.select("node", "blocks", "target", *_r("coverage", "identity", "mapq"), "strand", *_r("strand_share", "dominance"), "status")


@query(f"RECURSIVE {_LOCI};;SELECT target, a, b, round(overlap, 3) AS overlap, round(shorter, 6) AS shorter, round(reciprocal, 6) AS reciprocal, kind, CASE kind WHEN 'partial-overlap' THEN 'review' ELSE 'high' END AS confidence FROM ed")
def q_allele_edges(spark, sf):
    """Anchors that share bases of their merged intervals."""
    out = loci.allele_edges(_loci(spark, sf)[2], 0.1, 0.3, 0.2, 20_000)
    return out.select("target", "a", "b", F.round("overlap", 3).alias("overlap"), *_r("shorter", "reciprocal"), "kind", "confidence")


@query(f"""RECURSIVE {_LOCI}, bk AS (SELECT block_id, object_id, source_id || ':' || source_start || '-' || source_end AS node FROM layout), sg AS (SELECT block_id, CAST(block_id // 8 AS BIGINT) AS grp FROM layout WHERE block_id % 8 < 4),
og AS (SELECT grp, bk.* FROM bk JOIN sg USING (block_id)), gn AS (SELECT DISTINCT grp, node FROM og),
ex AS (SELECT DISTINCT grp, o.object_id, o.node AS locus FROM gn JOIN bk o ON o.node = gn.node WHERE NOT EXISTS (SELECT 1 FROM sg WHERE sg.grp = gn.grp AND sg.block_id = o.block_id)),
pa AS (SELECT DISTINCT source1 * 2 AS l, source2 * 2 AS r FROM contact WHERE source1 <> source2 AND count >= 45), bo AS (SELECT l, r FROM pa UNION ALL SELECT r, l FROM pa),
cp AS (SELECT DISTINCT sg.grp, o.object_id, least(l, r) || '-' || greatest(l, r) AS locus FROM bo JOIN sg ON sg.block_id = l JOIN bk o ON o.block_id = r WHERE NOT EXISTS (SELECT 1 FROM sg s2 WHERE s2.grp = sg.grp AND s2.block_id = r) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.grp = sg.grp AND ex.object_id = o.object_id)),
mi AS (SELECT grp, target, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY grp, target ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT grp, ti.*, CASE WHEN max(e) OVER (PARTITION BY grp, target ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS f FROM ti JOIN gn USING (node))) GROUP BY grp, target, i),
co AS (SELECT DISTINCT mi.grp, mi.target, o.object_id, greatest(mi.s, ti.s) AS s, least(mi.e, ti.e) AS e FROM mi JOIN ti ON ti.target = mi.target AND ti.s < mi.e AND mi.s < ti.e JOIN bk o ON o.node = ti.node WHERE NOT EXISTS (SELECT 1 FROM gn WHERE gn.grp = mi.grp AND gn.node = ti.node) AND NOT EXISTS (SELECT 1 FROM sg WHERE sg.grp = mi.grp AND sg.block_id = o.block_id)),
cu AS (SELECT grp, target, object_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY grp, target, object_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN max(e) OVER (PARTITION BY grp, target, object_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS f FROM co)) GROUP BY grp, target, object_id, i),
cs AS (SELECT grp, target, object_id, covered / span AS coverage FROM (SELECT grp, target, object_id, sum(e - s) AS covered FROM cu GROUP BY ALL) JOIN (SELECT grp, target, sum(e - s) AS span FROM mi GROUP BY ALL) USING (grp, target));;
SELECT grp AS "group", object_id, 'exact-source' AS kind, locus, 1.0 AS coverage FROM ex UNION ALL SELECT grp, object_id, 'contact-pair', locus, NULL FROM cp
UNION ALL SELECT grp, object_id, 'paf-locus', CAST(target AS VARCHAR), round(coverage, 6) FROM cs WHERE coverage >= 0.3 AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.grp = cs.grp AND ex.object_id = cs.object_id)""")
def q_occupied_loci(spark, sf):
    """What keeps every second group of blocks out of objects: their sources, contact pairs, and loci on the reference."""
    base, _, intervals = _loci(spark, sf)
    selected = base.filter("block_id % 8 < 4").select("block_id", F.expr("block_id div 8").alias("group"))
    pairs = views.contact(spark, sf).filter("source1 <> source2 AND count >= 45").select((F.col("source1") * 2).alias("left"), (F.col("source2") * 2).alias("right")).distinct()
    out = loci.occupied_loci(base, selected, pairs, intervals, 0.3, 20_000)
    return out.select("group", "object_id", "kind", "locus", *_r("coverage"))


@query(f"""RECURSIVE {_LOCI}, di AS (SELECT DISTINCT a, b FROM ed WHERE kind = 'allele'), gp AS (SELECT node, target AS grp FROM an WHERE status = 'anchor'),
ct AS (SELECT DISTINCT least(x.node, y.node) AS a, greatest(x.node, y.node) AS b FROM contact JOIN nd x ON x.source_id = source1 JOIN nd y ON y.source_id = source2 JOIN gp g ON g.node = x.node JOIN gp h ON h.node = y.node WHERE g.grp <> h.grp AND count > 0),
ma AS (SELECT a, b, 'direct-allele' AS reason FROM di UNION ALL SELECT a, b, 'cross-allele-nonmatch' FROM ct WHERE (a, b) NOT IN (SELECT (a, b) FROM di)),
hs AS (SELECT concat_ws('|', node, status, CAST(target AS VARCHAR), strand) AS t FROM an UNION ALL SELECT concat_ws('|', a, b, kind, CASE kind WHEN 'partial-overlap' THEN 'review' ELSE 'high' END) FROM ed UNION ALL SELECT concat_ws('|', a, b, reason) FROM ma);;
SELECT CAST(sum(blocks) FILTER (status <> 'anchor') AS BIGINT) AS excluded, coalesce(CAST(sum(blocks) FILTER (status LIKE 'multi-locus%') AS BIGINT), 0) AS multi, coalesce(CAST(sum(blocks) FILTER (status = 'multi-locus-split') AS BIGINT), 0) AS split, coalesce(CAST(sum(blocks) FILTER (status = 'multi-locus-repetitive') AS BIGINT), 0) AS repetitive,
  coalesce(CAST(sum(blocks) FILTER (status = 'multi-locus-mixed') AS BIGINT), 0) AS mixed, CAST(sum(blocks * (blocks - 1) // 2) AS BIGINT) AS duplicate_pairs, count(*) FILTER (status = 'anchor') AS anchors, (SELECT count(*) FROM ma WHERE reason = 'direct-allele') AS direct_pairs, (SELECT count(*) FROM ma WHERE reason <> 'direct-allele') AS cross_pairs,
  CAST((SELECT sum(CAST('0x' || substr(md5(t), 1, 12) AS BIGINT)) % 1000000007 FROM hs) AS BIGINT) AS fingerprint FROM an""")
def q_pruning_summary(spark, sf):
    """Counts of what anchors, alleles and masks leave out, and a fingerprint of them; no pair of groups is matched here."""
    base, found, intervals = _loci(spark, sf)
    edges = materialise(loci.allele_edges(intervals, 0.1, 0.3, 0.2, 20_000), "edges")
    names = base.select("source_id", loci.node_name().alias("node")).distinct()
    ends = [names.select(F.col("source_id").alias(f"source{n}"), F.col("node").alias(c)) for n, c in ((1, "a"), (2, "b"))]
    met = views.contact(spark, sf).join(ends[0], "source1").join(ends[1], "source2").select("a", "b", F.col("count").alias("score"))
    groups = found.filter("status = 'anchor'").select("node", F.col("target").alias("group"))
    masks = materialise(loci.masked_pairs(edges, groups, met, edges.select("a", "b").limit(0)), "masks")
    return loci.pruning_summary(found, edges, masks)


# places on the map

@query(_project_sql("""SELECT x_bin, y_bin, CASE WHEN count = 0 THEN 0 ELSE round_even(count / pow(2, floor(log2(count)) - 10), 0) * pow(2, floor(log2(count)) - 10) END AS count FROM (SELECT x // 5000 AS x_bin, y // 5000 AS y_bin, CAST(sum(share) AS DOUBLE) AS count FROM p GROUP BY 1, 2)"""))
def q_dense_tiles(spark, sf):
    """A map through dense tiles of half floats and back."""
    cells = contacts.project(views.contact(spark, sf), views.layout(spark, sf), 5_000)
    return tiles.dense_cells(tiles.dense_tiles(cells, 64, half=True), 64, half=True)


_ASKED = """asked AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_orderkey % 9 WHEN 0 THEN CAST(l_partkey * 2 AS VARCHAR) WHEN 1 THEN ' ' || l_partkey || ' ' WHEN 2 THEN l_partkey || ':100-900' WHEN 3 THEN l_partkey || ':1,000-99,000' WHEN 4 THEN l_partkey || ':900-100' WHEN 5 THEN l_partkey || ':5' WHEN 6 THEN '' WHEN 7 THEN 'P' || l_partkey ELSE l_partkey || ':1-99999999999999999999' END AS text FROM lineitem)"""


@query(f"""RECURSIVE {_ASKED}, r AS (SELECT DISTINCT id, text, trim(text) AS t, regexp_full_match(trim(text), '.+:[0-9,]+-[0-9,]+') AS rg FROM asked), q AS (SELECT *, CASE WHEN rg THEN trim(regexp_extract(t, '^(.+):([0-9,]+)-([0-9,]+)$', 1)) ELSE t END AS name, CASE WHEN rg THEN TRY_CAST(replace(regexp_extract(t, '^(.+):([0-9,]+)-([0-9,]+)$', 2), ',', '') AS BIGINT) END AS f, CASE WHEN rg THEN TRY_CAST(replace(regexp_extract(t, '^(.+):([0-9,]+)-([0-9,]+)$', 3), ',', '') AS BIGINT) END AS e FROM r),
w AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN NOT rg AND text LIKE '%:%' THEN 'form' WHEN rg AND (f IS NULL OR e IS NULL) THEN 'number' WHEN e <= f THEN 'order' END AS p0 FROM q),
nm AS (SELECT DISTINCT block_id, CAST(source_id AS VARCHAR) AS name FROM layout UNION SELECT block_id, CAST(block_id AS VARCHAR) FROM layout),
h AS (SELECT w.id, w.text, count(*) AS n, min(nm.block_id) AS block_id FROM w JOIN nm USING (name) WHERE p0 IS NULL GROUP BY ALL),
z AS (SELECT w.id, h.block_id, coalesce(f, source_start) AS s, coalesce(e, source_end) AS t, source_start, source_end, orientation, visual_start AS v, coalesce(p0, CASE WHEN h.block_id IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN coalesce(f, source_start) < source_start OR coalesce(e, source_end) > source_end THEN 'outside' END) AS problem FROM w LEFT JOIN h ON h.id = w.id AND h.text = w.text LEFT JOIN layout l ON l.block_id = h.block_id);;
SELECT id, CASE WHEN problem IS NULL THEN block_id END AS block_id, CASE WHEN problem IS NULL THEN CASE WHEN orientation = '-' THEN v + source_end - t ELSE v + s - source_start END END AS visual_start, CASE WHEN problem IS NULL THEN CASE WHEN orientation = '-' THEN v + source_end - s ELSE v + t - source_start END END AS visual_end, problem FROM z""")
def q_jumps(spark, sf):
    """Typed places of every form, resolved on the layout."""
    part = F.col("l_partkey").cast("string")
    forms = [(0, (F.col("l_partkey") * 2).cast("string")), (1, F.concat(F.lit(" "), part, F.lit(" "))), (2, F.concat(part, F.lit(":100-900"))), (3, F.concat(part, F.lit(":1,000-99,000"))), (4, F.concat(part, F.lit(":900-100"))), (5, F.concat(part, F.lit(":5"))), (6, F.lit("")), (7, F.concat(F.lit("P"), part)), (8, F.concat(part, F.lit(":1-99999999999999999999")))]
    asked = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.coalesce(*[F.when(F.col("l_orderkey") % 9 == k, text) for k, text in forms]).alias("text"))
    return navigation.jumps(views.layout(spark, sf), asked)


@query("""RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY visual_start, visual_end, block_id) AS k FROM layout), ax AS (SELECT * FROM (VALUES (2000000, 2600000), (4100000, 4900000)) t(a, b)),
fc AS (SELECT a, block_id FROM (SELECT a, block_id, row_number() OVER (PARTITION BY a ORDER BY (visual_start * 2 <= a + b AND visual_end * 2 > a + b) DESC, least(visual_end, b) - greatest(visual_start, a) DESC, visual_start) AS k FROM ax JOIN layout ON visual_end > a AND visual_start < b) WHERE k = 1),
f AS (SELECT block_id FROM fc UNION SELECT block_id FROM layout WHERE source_id % 50 = 7);;SELECT DISTINCT n.block_id FROM o n JOIN o c ON n.object_id = c.object_id AND abs(n.k - c.k) <= 3 JOIN f ON f.block_id = c.block_id""")
def q_view_neighbours(spark, sf):
    """Blocks beside the middle of a view and beside selected ones."""
    base = materialise(views.layout(spark, sf), "layout")
    return navigation.view_neighbours(base, (2_000_000, 2_600_000, 4_100_000, 4_900_000), base.filter("source_id % 50 = 7"), 3)


@query("""SELECT DISTINCT object_id FROM layout WHERE regexp_extract(object_id, '[0-9]') IN (SELECT regexp_extract(object_id, '[0-9]') FROM layout WHERE (visual_end > 2000000 AND visual_start < 2600000) OR (visual_end > 4100000 AND visual_start < 4900000))""")
def q_view_objects(spark, sf):
    """Objects of the columns, by their first digit, that a view shows."""
    base = materialise(views.layout(spark, sf), "layout")
    columns = base.select("object_id", F.regexp_extract("object_id", "[0-9]", 0).alias("column")).distinct()
    return navigation.view_objects(base, (2_000_000, 2_600_000, 4_100_000, 4_900_000), columns)


@query(f"""RECURSIVE {_PROJECT}, cells AS (SELECT x // 50000 AS x_bin, y // 50000 AS y_bin, sum(share) AS count FROM p GROUP BY 1, 2), {_MEMBERS};;
SELECT source, target, round(raw, 6) AS raw_count FROM (SELECT least(m.block_id, n.block_id) AS source, greatest(m.block_id, n.block_id) AS target, sum(count * m.share * n.share) AS raw FROM cells JOIN mem m ON m.bin = x_bin JOIN mem n ON n.bin = y_bin WHERE m.block_id <> n.block_id GROUP BY 1, 2) WHERE (source % 10 = 2) <> (target % 10 = 2)""")
def q_selected_links(spark, sf):
    """Links between selected blocks and others."""
    base = materialise(views.layout(spark, sf), "layout")
    out = navigation.selected_links(contacts.project(views.contact(spark, sf), base, 50_000), base, 50_000, base.filter("block_id % 10 = 2"))
    return out.select("source", "target", F.round("raw_count", 6).alias("raw_count"))


_HASHED = """h1 AS (SELECT *, CAST((CAST(xor(x_bin, 2654435769) AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS a FROM cells), h2 AS (SELECT *, xor(a, CAST((CAST(xor(y_bin, a // 65536) AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT)) AS b FROM h1), h3 AS (SELECT x_bin, y_bin, count, xor(b, b // 65536) AS h FROM h2)"""


@query(f"""RECURSIVE {_PROJECT}, cells AS (SELECT x // 5000 AS x_bin, y // 5000 AS y_bin, CAST(sum(share) AS DOUBLE) AS count FROM p GROUP BY 1, 2), {_HASHED};;
SELECT x_bin, y_bin, count FROM h3 WHERE h < CAST(floor(1000.0::DOUBLE / (SELECT count(*) FROM cells) * 4294967296) AS BIGINT) ORDER BY x_bin, y_bin LIMIT 1000""")
def q_thinned_cells(spark, sf):
    """A map thinned to a thousand cells at most, by the hashes of their places."""
    return navigation.thinned(contacts.project(views.contact(spark, sf), views.layout(spark, sf), 5_000), 1_000).withColumn("count", F.col("count").cast("double"))


@query("""RECURSIVE n AS (SELECT source_id, count(*) AS n FROM layout WHERE source_id % 6 <> 5 GROUP BY 1);;SELECT count(*) FILTER (a.n = 1 AND b.n = 1) AS "unique", count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL AND NOT (a.n = 1 AND b.n = 1)) AS ambiguous, count(*) FILTER (a.n IS NULL OR b.n IS NULL) AS unplaced FROM glink LEFT JOIN n a ON a.source_id = from_segment LEFT JOIN n b ON b.source_id = to_segment""")
def q_ambiguous_links(spark, sf):
    """Links of the graph by how often their sources are placed."""
    return navigation.ambiguous_links(views.glink(spark, sf), views.layout(spark, sf).filter("source_id % 6 <> 5"))


@query(f"""RECURSIVE {_ALINK}, n1 AS (SELECT source_id FROM layout GROUP BY 1 HAVING count(*) = 1), pr AS (SELECT block_id AS right_id, source_id AS rs, orientation AS ro, gap_before AS gap, lag(block_id) OVER w AS left_id, lag(source_id) OVER w AS ls, lag(orientation) OVER w AS lo FROM layout WINDOW w AS (PARTITION BY object_id ORDER BY ord));;
SELECT DISTINCT line_no, left_id, right_id, gap FROM pr JOIN lk ON lk.ls = pr.ls AND lk.rs = pr.rs AND fs = CASE WHEN lo = '-' THEN 'start' ELSE 'end' END AND ts = CASE WHEN ro = '-' THEN 'end' ELSE 'start' END WHERE gap > 0 AND pr.ls IN (SELECT source_id FROM n1) AND pr.rs IN (SELECT source_id FROM n1)""")
def q_gap_bridges(spark, sf):
    """Links that close a gap between neighbours."""
    base, links, _ = _graph(spark, sf)
    return navigation.gap_bridges(links, base)


# levels and scales from one scan

@query("""RECURSIVE up AS (SELECT r, b.bin_id AS parent_id, c.base + b.start // r AS bin_id FROM bins b JOIN (SELECT r, chrom_id, CAST(coalesce(sum((length + r - 1) // r) OVER (PARTITION BY r ORDER BY chrom_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM chrom CROSS JOIN (VALUES (4000), (6000), (12000)) t(r)) c USING (chrom_id));;
SELECT CAST(x.r AS BIGINT) AS resolution, x.bin_id AS bin1_id, y.bin_id AS bin2_id, CAST(sum(count) AS BIGINT) AS count FROM pixel JOIN up x ON x.parent_id = bin1_id JOIN up y ON y.parent_id = bin2_id AND x.r = y.r GROUP BY 1, 2, 3""")
def q_paired_levels(spark, sf):
    """Levels of which two come from one scan of the base."""
    chroms, pixels = materialise(views.chrom(spark, sf), "chroms"), materialise(views.pixel(spark, sf), "pixels")
    levels = pyramid.build_paired_levels(pixels, chroms, [1_000, 4_000, 6_000, 12_000], 1_000)
    parts = [levels[r].select(F.lit(r).cast("long").alias("resolution"), "bin1_id", "bin2_id", "count") for r in (4_000, 6_000, 12_000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""RECURSIVE sym AS (SELECT bin1_id AS i, count FROM pixel UNION ALL SELECT bin2_id, count FROM pixel WHERE bin1_id <> bin2_id), w AS (SELECT i AS bin_id, 1.0::DOUBLE / sum(count) AS vc, sqrt(1.0::DOUBLE / sum(count)) AS sq, CASE WHEN i % 5 <> 2 THEN 1.0::DOUBLE / (1 + i % 3) END AS ice FROM sym GROUP BY 1),
m AS (SELECT CASE WHEN a.chrom_id = b.chrom_id THEN a.chrom_id END AS chrom_id, count * CASE WHEN bin1_id = bin2_id THEN 1 ELSE 2 END AS m, x.vc * y.vc AS vc, x.sq * y.sq AS sq, x.ice * y.ice AS ice FROM pixel JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id JOIN w x ON x.bin_id = bin1_id JOIN w y ON y.bin_id = bin2_id);;
SELECT 'ICE' AS method, CAST(NULL AS BIGINT) AS chrom_id, round(sqrt(sum(m) FILTER (ice IS NOT NULL) / sum(m * ice)), 6) AS scale FROM m UNION ALL SELECT 'VC', chrom_id, round(sqrt(sum(m) / sum(m * vc)), 6) FROM m WHERE chrom_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'VC_SQRT', chrom_id, round(sqrt(sum(m) / sum(m * sq)), 6) FROM m WHERE chrom_id IS NOT NULL GROUP BY 2""")
def q_fused_scales(spark, sf):
    """Scales of weights of the whole matrix and of chromosomes, from one scan."""
    pixels = materialise(views.pixel(spark, sf), "pixels")
    cover = balance.row_sums(pixels).join(pyramid.bins(views.chrom(spark, sf), 1_000).select("bin_id", "chrom_id"), "bin_id")
    weights = cover.select("bin_id", "chrom_id", (1.0 / F.col("total")).alias("VC"), F.sqrt(1.0 / F.col("total")).alias("VC_SQRT"), F.when(F.col("bin_id") % 5 != 2, 1.0 / (1 + F.col("bin_id") % 3)).alias("ICE"))
    return balance.fused_scales(pixels, weights, ("ICE",)).select("method", "chrom_id", F.round("scale", 6).alias("scale"))


# placements of runs of blocks

_RUNS = f"""{_ALINK}, ru AS (SELECT *, min(block_id) OVER (PARTITION BY grp) AS selected FROM sel), nb AS (SELECT block_id, lag(block_id) OVER w AS l, lead(block_id) OVER w AS r FROM layout WINDOW w AS (PARTITION BY object_id ORDER BY ord)),
un AS (SELECT u.*, f.l AS left_id, e.r AS right_id FROM (SELECT selected, any_value(object_id) AS object_id, arg_min(block_id, ord) AS first_id, arg_max(block_id, ord) AS last_id, min(visual_start) AS pos FROM ru GROUP BY 1) u JOIN nb f ON f.block_id = first_id JOIN nb e ON e.block_id = last_id),
ch AS (SELECT selected, block_id AS partner FROM un JOIN layout ON block_id IN (selected + 10, selected + 22)), ori AS (SELECT * FROM (VALUES ('+'), ('-')) t(o)),
bd AS (SELECT l.object_id, nb.l AS left_id, l.block_id AS right_id, visual_start AS pos FROM layout l JOIN nb USING (block_id) UNION ALL SELECT l.object_id, l.block_id, NULL, visual_end FROM layout l JOIN nb USING (block_id) WHERE nb.r IS NULL),
ca AS (SELECT selected, object_id, left_id, right_id, o AS orientation, pos, o = '+' AS is_current FROM un CROSS JOIN ori WHERE selected IN (SELECT selected FROM ch) UNION ALL SELECT DISTINCT ch.selected, bd.object_id, bd.left_id, bd.right_id, o, bd.pos, false FROM ch JOIN bd ON partner = left_id OR partner = right_id CROSS JOIN ori
  WHERE NOT EXISTS (SELECT 1 FROM ru WHERE ru.selected = ch.selected AND ru.block_id = bd.left_id) AND NOT EXISTS (SELECT 1 FROM ru WHERE ru.selected = ch.selected AND ru.block_id = bd.right_id))"""


def _runs(spark, sf):
    base, _, groups = _graph(spark, sf)
    base = materialise(layout.with_visual(base), "layout")
    selected = materialise(groups.withColumn("selected", F.min("block_id").over(Window.partitionBy("group"))).select("block_id", "selected"), "selected")
    units = materialise(placement.run_units(base, selected), "units")
    chosen = units.select("selected", F.explode(F.array(F.col("selected") + 10, F.col("selected") + 22)).alias("partner")).join(base.select(F.col("block_id").alias("partner")), "partner", "left_semi")
    return base, units, placement.run_candidates(base, chosen, units, selected)


@query(f"RECURSIVE {_RUNS};;SELECT selected, object_id, left_id, right_id, orientation, CAST(pos AS BIGINT) AS place, is_current FROM ca")
def q_run_candidates(spark, sf):
    """Where runs of neighbours could stand, in both inner orders."""
    return _runs(spark, sf)[2].withColumnRenamed("at", "place")


@query(f"""RECURSIVE {_RUNS}, jo AS (SELECT ca.*, s.side, CASE s.side WHEN 'left' THEN ca.left_id ELSE ca.right_id END AS neighbour, CASE WHEN (s.side = 'left') = (orientation = '+') THEN first_id ELSE last_id END AS own_block, CASE WHEN (s.side = 'left') = (orientation = '+') THEN 'l' ELSE 'r' END AS own_side FROM ca JOIN un USING (selected) CROSS JOIN (VALUES ('left'), ('right')) s(side));;
SELECT selected, jo.object_id, jo.left_id, jo.right_id, jo.orientation, side, neighbour, own_block, own_side, CASE WHEN side = 'left' THEN 'r' ELSE 'l' END AS their_side, CASE WHEN (own_side = 'l') = (o.orientation = '+') THEN 'start' ELSE 'end' END AS own_end, CASE WHEN (side = 'right') = (t.orientation = '+') THEN 'start' ELSE 'end' END AS their_end,
  CASE WHEN jo.orientation = '+' THEN o.orientation WHEN o.orientation = '+' THEN '-' ELSE '+' END AS own_new FROM jo JOIN layout o ON o.block_id = own_block JOIN layout t ON t.block_id = neighbour""")
def q_run_junctions(spark, sf):
    """The outer ends that meet where a run is put."""
    base, units, found = _runs(spark, sf)
    return placement.run_junctions(found, base, units).select("selected", "object_id", "left_id", "right_id", "orientation", "side", "neighbour", "own_block", "own_side", "their_side", "own_end", "their_end", "own_new")


@query("""RECURSIVE wi AS (SELECT source_id, source_id * 2 AS w, CAST(0 AS BIGINT) AS s, length // 3 AS e FROM contig UNION ALL SELECT source_id, source_id * 2 + 1, length // 3, length FROM contig WHERE source_id % 4 <> 1);;
SELECT least(a.w, b.w) AS w1, greatest(a.w, b.w) AS w2, CAST(sum(count) AS BIGINT) AS count FROM contact JOIN wi a ON a.source_id = source1 AND start1 >= a.s AND start1 < a.e JOIN wi b ON b.source_id = source2 AND start2 >= b.s AND start2 < b.e GROUP BY 1, 2""")
def q_window_index(spark, sf):
    """Contacts between windows of unequal lengths."""
    base = views.contig(spark, sf)
    third = F.expr("length div 3")
    first = base.select("source_id", (F.col("source_id") * 2).alias("window"), F.lit(0).cast("long").alias("start"), third.alias("end"))
    rest = base.filter("source_id % 4 <> 1").select("source_id", (F.col("source_id") * 2 + 1).alias("window"), third.alias("start"), F.col("length").alias("end"))
    return contacts.window_pairs(views.contact(spark, sf), first.unionByName(rest), 10_000, views.line_count(spark, sf))
