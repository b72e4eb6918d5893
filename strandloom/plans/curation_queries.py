"""The queries of the curation operators, each with SQL that gives the same rows; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.storage import table
from strandloom.operators import curation, layout, synteny
from strandloom.plans import views
from strandloom.plans.catalogue import query

_GAPPED = "g0 AS (SELECT * REPLACE (CASE WHEN source_id % 4 = 0 THEN 70 ELSE 0 END AS gap_before) FROM layout), gu AS (SELECT *, last_value(CASE WHEN gap_before > 0 OR k = 1 THEN block_id END IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS unit FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ord) AS k FROM g0))"
_REPAIR = """rp AS (SELECT *, k2 > 1 AND lag_unit <> unit AND gap_before <= 0 AS lacks FROM (SELECT *, row_number() OVER w AS k2, lag(unit) OVER w AS lag_unit, first_value(gap_before) OVER w AS lead_gap FROM edited WINDOW w AS (PARTITION BY object_id ORDER BY ord))),
  fixed AS (SELECT *, CASE WHEN k2 = 1 THEN 0 WHEN lacks THEN CASE WHEN sum(CAST(lacks AS INT)) OVER (PARTITION BY object_id ORDER BY ord ROWS UNBOUNDED PRECEDING) = 1 AND lead_gap > 0 THEN lead_gap ELSE 100 END ELSE gap_before END AS gap FROM rp)
SELECT block_id, object_id, source_id, source_start, source_end, orientation, CAST(gap AS BIGINT) AS gap_before, CAST(ord AS BIGINT) AS ord FROM fixed"""


def _sql(ctes: str, body: str) -> str:
    """Common tables behind the views', and the query itself."""
    return f", {ctes} {body}"


def _gapped(spark, sf):
    return views.layout(spark, sf).withColumn("gap_before", F.when(F.col("source_id") % 4 == 0, 70).otherwise(0).cast("long"))


@query(_sql(f"{_GAPPED}, edited AS (SELECT * FROM gu WHERE source_id % 8 <> 0)," + _REPAIR.split("SELECT block_id")[0], "SELECT block_id" + _REPAIR.split("SELECT block_id")[1]))
def q_edit_delete_repaired(spark, sf):
    base = _gapped(spark, sf)
    return curation.delete_repaired(base, base.filter("source_id % 8 = 0").select("block_id"))


@query(_sql(f"{_GAPPED}, mv AS (SELECT DISTINCT unit FROM gu WHERE source_id % 13 = 0), edited0 AS (SELECT gu.* REPLACE (CASE WHEN mv.unit IS NOT NULL THEN 'debris' ELSE object_id END AS object_id), mv.unit IS NOT NULL AS moves FROM gu LEFT JOIN mv USING (unit)), edited AS (SELECT * REPLACE (row_number() OVER (ORDER BY moves, ord) AS ord) FROM edited0)," + _REPAIR.split("SELECT block_id")[0], "SELECT block_id" + _REPAIR.split("SELECT block_id")[1]))
def q_edit_debris(spark, sf):
    base = _gapped(spark, sf)
    return curation.move_to_debris(base, base.filter("source_id % 13 = 0").select("block_id"))


@query(_sql(f"{_GAPPED}, tgt AS (SELECT object_id AS o, ord AS place FROM g0 WHERE block_id = 14), edited0 AS (SELECT gu.* REPLACE (CASE WHEN block_id IN (62, 102, 4) THEN o ELSE object_id END AS object_id), CASE WHEN block_id IN (62, 102, 4) THEN place * 2 + 1 ELSE ord * 2 END AS pos FROM gu, tgt), edited AS (SELECT * REPLACE (row_number() OVER (ORDER BY pos, ord) AS ord) FROM edited0)," + _REPAIR.split("SELECT block_id")[0], "SELECT block_id" + _REPAIR.split("SELECT block_id")[1]))
def q_edit_recommended(spark, sf):
    return curation.apply_recommendation(_gapped(spark, sf), F.col("block_id").isin(62, 102, 4), 14, behind=True, turned=False)


_OBJECT_NAMES = "SELECT DISTINCT object_id, CASE WHEN right(object_id, 1) = '1' THEN '  ' WHEN right(object_id, 1) = '2' THEN 'a b' WHEN right(object_id, 1) = '3' THEN ' ' || object_id ELSE replace(object_id, '4', '5') END AS name FROM layout"


def _requests(spark, sf):
    last = F.substring("object_id", -1, 1)
    name = F.when(last == "1", "  ").when(last == "2", "a b").when(last == "3", F.concat(F.lit(" "), "object_id")).otherwise(F.regexp_replace("object_id", "4", "5"))
    return views.layout(spark, sf).select("object_id", name.alias("name")).distinct()


@query(f"SELECT object_id, trim(name) AS name, CASE WHEN trim(name) = '' THEN 'empty' WHEN regexp_matches(trim(name), '\\s') THEN 'white space' WHEN trim(name) = object_id THEN NULL WHEN trim(name) IN (SELECT object_id FROM layout) THEN 'taken' END AS error FROM ({_OBJECT_NAMES})")
def q_rename_errors(spark, sf):
    return curation.rename_errors(views.layout(spark, sf), _requests(spark, sf))


@query("SELECT block_id, ord FROM layout WHERE ord BETWEEN (SELECT min(ord) FROM layout WHERE block_id IN (20, 141)) AND (SELECT max(ord) FROM layout WHERE block_id IN (20, 141)) OR FALSE")
def q_blocks_between(spark, sf):
    return curation.blocks_between(views.layout(spark, sf), 141, 20).select("block_id", "ord")


@query(_sql(_GAPPED, "SELECT object_id, min(s) AS visual_start, max(e) AS visual_end, count(*) AS total_count, CAST(sum(c) AS BIGINT) AS selected_count, CAST(sum(e - s) AS BIGINT) AS total_length, CAST(sum((e - s) * c) AS BIGINT) AS selected_length FROM (SELECT object_id, unit, min(visual_start) AS s, max(visual_end) AS e, max(CAST(source_id % 5 = 0 AS INT)) AS c FROM gu GROUP BY ALL) GROUP BY ALL"))
def q_chromosome_groups(spark, sf):
    return curation.chromosome_groups(_gapped(spark, sf), F.col("source_id") % 5 == 0)


@query("SELECT object_id, block_id, visual_start - gap_before AS gap_start, visual_start AS gap_end FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ord) AS k FROM layout) WHERE k > 1 AND gap_before > 0")
def q_gap_ranges(spark, sf):
    return curation.gap_ranges(views.layout(spark, sf))


@query("SELECT block_id, object_id, source_id, source_start, source_end, orientation, gap_before, ord FROM layout WHERE source_id % 3 <> 1 AND source_id % 7 <> 0")
def q_history_undo(spark, sf):
    base = views.layout(spark, sf).select(*layout.COLUMNS)
    history = curation.History.of(base).do(base.filter("source_id % 3 <> 1")).do(base.filter("source_id % 5 <> 0")).undo()
    history = history.do(history.layout.filter("source_id % 7 <> 0")).do(base.limit(0)).undo_to(2)
    return history.undo().redo().layout


@query("SELECT block_id, CASE WHEN source_id % 3 = 0 OR source_id % 5 = 0 THEN 's' || source_id ELSE object_id END AS object_id, CASE WHEN source_id % 2 = 0 THEN 's' || source_id || ':x' ELSE CAST(source_id AS VARCHAR) END AS source_id, source_start, source_end, orientation, gap_before FROM layout")
def q_layout_defaults(spark, sf):
    raw = views.layout(spark, sf).select(
        "block_id", F.concat(F.lit("s"), "source_id", F.lit(":x")).alias("id"), F.when(F.col("source_id") % 3 == 0, None).when(F.col("source_id") % 5 == 0, "").otherwise(F.col("object_id")).alias("object_id"),
        F.when(F.col("source_id") % 2 == 1, F.col("source_id").cast("string")).alias("source_id"), F.lit(None).cast("long").alias("source_start"), "source_end", F.when(F.col("orientation") == "-", "-").alias("orientation"), "gap_before",
    )
    return curation.normalised_layout(raw)


@query("SELECT chrom_id, min(bin_id) AS first_bin, count(*) AS bins, max(bin_id) - min(bin_id) + 1 = count(*) AND chrom_id % 9 <> 0 OR count(*) = 1 AS ordered FROM bins GROUP BY chrom_id")
def q_chrom_offsets(spark, sf):
    from strandloom.operators.pyramid import bins

    rows = bins(views.chrom(spark, sf), 1000)
    return curation.chrom_offsets(rows.withColumn("start", F.when(F.col("chrom_id") % 9 == 0, -F.col("start")).otherwise(F.col("start"))))


_BROKEN = "br AS (SELECT CASE WHEN count % 7 = 0 THEN bin2_id ELSE bin1_id END AS bin1_id, CASE WHEN count % 7 = 0 THEN bin1_id WHEN count % 11 = 0 THEN -1 ELSE bin2_id END AS bin2_id, CASE WHEN count % 13 = 0 THEN 0 ELSE count END AS count FROM pixel)"


@query(_sql(_BROKEN, "SELECT problem, count(*) AS rows FROM (SELECT 'outside' AS problem FROM br WHERE bin1_id < 0 OR bin2_id < 0 OR bin1_id >= 100000 OR bin2_id >= 100000 UNION ALL SELECT 'lower triangle' FROM br WHERE bin1_id > bin2_id UNION ALL SELECT 'not positive' FROM br WHERE count <= 0 UNION ALL SELECT 'repeated' FROM br GROUP BY bin1_id, bin2_id HAVING count(*) > 1) GROUP BY problem"))
def q_pixel_problems(spark, sf):
    p = views.pixel(spark, sf)
    swapped, away = F.col("count") % 7 == 0, F.col("count") % 11 == 0
    broken = p.select(F.when(swapped, F.col("bin2_id")).otherwise(F.col("bin1_id")).alias("bin1_id"), F.when(swapped, F.col("bin1_id")).when(away, -1).otherwise(F.col("bin2_id")).alias("bin2_id"), F.when(F.col("count") % 13 == 0, 0).otherwise(F.col("count")).alias("count"))
    return curation.pixel_problems(broken, 100_000)


_SCAFFOLD = "sc AS (SELECT p_partkey AS source, CASE WHEN p_partkey % 6 = 0 THEN 'Unplaced' WHEN p_partkey % 5 = 0 THEN p_brand ELSE 'Chr' || (p_partkey % 12) || 'g' || (p_partkey % 4) END AS name FROM part), ho AS (SELECT DISTINCT name, CASE WHEN name LIKE 'Chr%' THEN split_part(name, 'g', 1) END AS col, CASE WHEN name LIKE 'Chr%' THEN split_part(name, 'g', 2) END AS member FROM sc)"


def _scaffolds(spark, sf):
    key = F.col("p_partkey")
    name = F.when(key % 6 == 0, "Unplaced").when(key % 5 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("Chr"), key % 12, F.lit("g"), key % 4))
    return table(spark, sf, "part").select(key.alias("source"), name.alias("name"))


@query(_sql(_SCAFFOLD, 'SELECT name, col AS "column", member FROM ho'))
def q_homologs(spark, sf):
    return curation.homologs(_scaffolds(spark, sf).select("name").distinct())


@query(_sql(_SCAFFOLD, "SELECT line_no, CASE WHEN a.name = b.name THEN 'within-scaffold' WHEN ha.col = hb.col THEN 'homolog' ELSE 'non-homolog' END AS scope FROM glink JOIN sc a ON from_segment = a.source JOIN sc b ON to_segment = b.source JOIN ho ha ON ha.name = a.name JOIN ho hb ON hb.name = b.name"))
def q_link_scope(spark, sf):
    names = _scaffolds(spark, sf)
    links = views.glink(spark, sf).join(names.select(F.col("source").alias("from_segment"), F.col("name").alias("from_scaffold")), "from_segment").join(names.select(F.col("source").alias("to_segment"), F.col("name").alias("to_scaffold")), "to_segment")
    return curation.link_scope(links.select("line_no", "from_scaffold", "to_scaffold"), curation.homologs(names.select("name").distinct())).select("line_no", "scope")


@query(_sql("nd AS (SELECT block_id AS node, ord FROM layout), rk AS (SELECT node, row_number() OVER (ORDER BY CAST(node % 50 = 0 AS INT) DESC, ord, node) AS k, count(*) FILTER (node % 50 = 0) OVER () AS r, node % 50 = 0 AS req FROM nd), kept AS (SELECT node FROM rk WHERE req OR k <= 400)", "SELECT line_no, a, b FROM (SELECT line_no, from_segment * 2 AS a, to_segment * 2 AS b FROM glink) WHERE a IN (SELECT node FROM kept) AND b IN (SELECT node FROM kept)"))
def q_graph_budget(spark, sf):
    """Links among 400 nodes at most: the limit is the operator."""
    nodes = views.layout(spark, sf).select(F.col("block_id").alias("node"), "ord")
    edges = views.glink(spark, sf).select("line_no", (F.col("from_segment") * 2).alias("a"), (F.col("to_segment") * 2).alias("b"))
    return curation.limit_graph(nodes, edges, 400, F.col("node") % 50 == 0)[1]


@query('SELECT c.l_orderkey * 10 + c.l_linenumber AS query, block_id FROM (SELECT *, l_orderkey * 7919 % 20000000 AS s FROM lineitem WHERE l_linenumber = 1) c JOIN layout ON visual_start <= s + 5000 AND visual_end >= s')
def q_ranges_closed(spark, sf):
    start = F.col("l_orderkey") * 7919 % 20_000_000
    asked = table(spark, sf, "lineitem").filter("l_linenumber = 1").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query"), (start + 5000).alias("start"), start.alias("end"))
    return curation.overlapping_closed(asked, views.layout(spark, sf))


_MASKS = "m0 AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber <= 3), m1 AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber IN (2, 4)), m2 AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 45)"


def _mask(spark, sf, condition, name=None):
    rows = table(spark, sf, "lineitem").filter(condition).select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return rows if name is None else rows.withColumn("mask", F.lit(name))


@query(_sql(_MASKS, "SELECT a, b, arg_max(mask, k) AS mask FROM (SELECT a, b, 0 AS k, 'duplicate' AS mask FROM m0 UNION ALL SELECT a, b, 1, 'cross' FROM m1 UNION ALL SELECT a, b, 2, 'allele' FROM m2) GROUP BY a, b"))
def q_mask_precedence(spark, sf):
    return curation.by_precedence(_mask(spark, sf, "l_linenumber <= 3", "duplicate"), _mask(spark, sf, "l_linenumber IN (2, 4)", "cross"), _mask(spark, sf, "l_quantity > 45", "allele"))


@query(_sql(_MASKS, "SELECT (SELECT count(*) FROM (FROM m0 EXCEPT FROM m1)) AS only_one, (SELECT count(*) FROM (FROM m1 EXCEPT FROM m0)) AS only_other, (SELECT count(*) FROM (FROM m0 INTERSECT FROM m1)) AS both"))
def q_mask_difference(spark, sf):
    return curation.mask_difference(_mask(spark, sf, "l_linenumber <= 3"), _mask(spark, sf, "l_linenumber IN (2, 4)"))


@query("SELECT CAST(factor AS INTEGER) AS factor, bin1_id // factor AS bin1_id, bin2_id // factor AS bin2_id, CAST(sum(count) AS BIGINT) AS count FROM pixel, (SELECT unnest([4, 10]) AS factor) GROUP BY ALL")
def q_pyramid_siblings(spark, sf):
    return curation.sibling_levels(views.pixel(spark, sf), [4, 10])


@query("SELECT l_suppkey, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean, round(exp(avg(ln(CAST(l_quantity AS DOUBLE)))), 6) AS geometric FROM lineitem WHERE l_quantity > 0 GROUP BY l_suppkey")
def q_positive_means(spark, sf):
    return curation.positive_means(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity").select("l_suppkey", F.round("mean", 6).alias("mean"), F.round("geometric", 6).alias("geometric"))


@query("SELECT aln_id, CASE WHEN (l % 2 = 0) = (strand = '+') THEN target_start ELSE target_end END AS coordinate FROM (SELECT *, aln_id % 100 AS l FROM paf)")
def q_anchor_coordinate(spark, sf):
    side = F.when(F.col("aln_id") % 100 % 2 == 0, "start").otherwise("end")
    return views.paf(spark, sf).select("aln_id", curation.anchor_coordinate(side, F.col("strand"), F.col("target_start"), F.col("target_end")).alias("coordinate"))


@query("SELECT count(*) AS alignments, count(*) FILTER (block_len >= 3000) AS retained, count(*) FILTER (block_len < 3000) AS discarded, count(DISTINCT query_name) FILTER (block_len >= 3000) AS queries, count(DISTINCT target_name) FILTER (block_len >= 3000) AS targets FROM paf")
def q_paf_preview(spark, sf):
    return synteny.preview(views.paf(spark, sf), F.col("block_len") >= 3000)


@query(None)
def q_paf_consolidated(spark, sf):
    """Chains, the share of the best and arbitration composed; tests hold it against a plain version."""
    return synteny.consolidate(views.paf(spark, sf, ids=False), 3_000)
