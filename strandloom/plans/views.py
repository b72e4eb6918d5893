"""Integer-only views of the star-schema tables as layouts, contacts, tracks, alignments and graphs.

Each view has its SQL beside it, so that both engines compute the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.running import total_before
from strandloom.functions.storage import table
from strandloom.operators.layout import with_visual

SQL = """
contig AS (SELECT p_partkey AS source_id, CAST(p_size AS BIGINT) * 1000 AS length, p_brand AS object_id, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS orientation FROM part),
placed AS (SELECT 0 AS copy, * FROM contig UNION ALL SELECT 1, source_id, length, '~copy', orientation FROM contig WHERE source_id % 10 = 0),
layout AS (
  SELECT source_id * 2 + copy AS block_id, object_id, source_id, CAST(0 AS BIGINT) AS source_start, length AS source_end, orientation, CAST(100 AS BIGINT) AS gap_before,
    row_number() OVER (ORDER BY object_id, source_id) AS ord,
    CAST(sum(length + 100) OVER (ORDER BY object_id, source_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - length AS visual_start,
    CAST(sum(length + 100) OVER (ORDER BY object_id, source_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visual_end
  FROM placed),
line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
ends AS (SELECT l_orderkey, k, l_partkey AS source, (l_orderkey * 7919 % length) // 1000 * 1000 AS start, CAST(l_quantity AS BIGINT) AS q FROM line JOIN contig ON l_partkey = source_id),
contact AS (SELECT a.source AS source1, a.start AS start1, b.source AS source2, b.start AS start2, a.q AS count FROM ends a JOIN ends b ON a.l_orderkey = b.l_orderkey AND b.k = a.k + 1),
cov AS (SELECT l_partkey AS chrom, l_orderkey * 131 % length AS start, least(l_orderkey * 131 % length + 500, length) AS "end", l_quantity AS value FROM lineitem JOIN contig ON l_partkey = source_id),
paf0 AS (SELECT l_orderkey, k, l_linenumber, l_partkey AS query_name, l_suppkey AS target_name, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, length AS query_len,
  l_orderkey * 131 % length AS query_start, least(l_orderkey * 131 % length + 200 + CAST(l_quantity AS BIGINT) * 100, length) AS query_end, l_orderkey * 517 % 1000000 AS target_start FROM line JOIN contig ON l_partkey = source_id),
paf AS (SELECT l_orderkey * 100 + k AS aln_id, query_name, target_name, strand, query_len, query_start, query_end, target_start, target_start + query_end - query_start AS target_end,
  (query_end - query_start) * (80 + l_linenumber) // 100 AS matches, query_end - query_start AS block_len, CAST(l_linenumber * 8 AS INTEGER) AS mapq FROM paf0),
chrom AS (SELECT source_id AS chrom_id, length FROM contig),
bin AS (SELECT CAST(coalesce(sum(length // 1000) OVER (ORDER BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, source_id AS chrom_id, length FROM contig),
pixel0 AS (SELECT b1.base + start1 // 1000 AS i, b2.base + start2 // 1000 AS j, count FROM contact JOIN bin b1 ON source1 = b1.chrom_id JOIN bin b2 ON source2 = b2.chrom_id),
pixel AS (SELECT least(i, j) AS bin1_id, greatest(i, j) AS bin2_id, CAST(sum(count) AS BIGINT) AS count FROM pixel0 GROUP BY 1, 2),
bins AS (SELECT base + k AS bin_id, chrom_id, k * 1000 AS start, (k + 1) * 1000 AS "end" FROM (SELECT base, chrom_id, unnest(range(0, length // 1000)) AS k FROM bin)),
glink AS (SELECT a.l_orderkey * 100 + a.k AS line_no, a.source AS from_segment, CASE WHEN a.start // 1000 % 2 = 0 THEN 'start' ELSE 'end' END AS from_side, b.source AS to_segment,
  CASE WHEN b.start // 1000 % 2 = 0 THEN 'start' ELSE 'end' END AS to_side, CASE WHEN a.q % 3 = 0 THEN '*' ELSE a.q || 'M' END AS overlap, a.q AS bases FROM ends a JOIN ends b ON a.l_orderkey = b.l_orderkey AND b.k = a.k + 1 WHERE a.source <> b.source)
"""


def contig(spark: SparkSession, sf: str) -> DataFrame:
    """A contig for each part."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("source_id"), (F.col("p_size").cast("long") * 1000).alias("length"), F.col("p_brand").alias("object_id"), F.when(F.col("p_partkey") % 3 == 0, "-").otherwise("+").alias("orientation"))


def layout(spark: SparkSession, sf: str) -> DataFrame:
    """Every contig in its brand's object, and each tenth once more in an object of copies, with visual coordinates."""
    base = contig(spark, sf)
    placed = base.withColumn("copy", F.lit(0)).unionByName(base.filter("source_id % 10 = 0").withColumn("object_id", F.lit("~copy")).withColumn("copy", F.lit(1)))
    # ord from counts by object, so that only objects are numbered in one window
    sizes = placed.groupBy("object_id").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.select("object_id", F.coalesce(F.sum("_n").over(Window.orderBy("object_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = placed.join(offset, "object_id").withColumn("ord", (F.col("_o") + F.row_number().over(Window.partitionBy("object_id").orderBy("source_id"))).cast("long"))
    rows = numbered.select((F.col("source_id") * 2 + F.col("copy")).alias("block_id"), "object_id", "source_id", F.lit(0).cast("long").alias("source_start"), F.col("length").alias("source_end"), "orientation", F.lit(100).cast("long").alias("gap_before"), "ord")
    return with_visual(rows)


#: Lines of a partition that windows by order sort.
LINE_ROWS = 500_000


def line_count(spark: SparkSession, sf: str) -> int:
    """Lines, from the files' footers; there are at most as many contacts."""
    return table(spark, sf, "lineitem").count()


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their number ``k`` in the order, dealt by order to as many tasks as their count asks for, so that no task grows with the table."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, sf, "lineitem")
    dealt = lines.repartition(max(spark.sparkContext.defaultParallelism, -(-line_count(spark, sf) // LINE_ROWS)), "l_orderkey")
    return dealt.withColumn("k", F.row_number().over(order))


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    joined = _lines(spark, sf).join(contig(spark, sf), F.col("l_partkey") == F.col("source_id"))
    return joined.select("l_orderkey", "k", F.col("l_partkey").alias("source"), F.expr("(l_orderkey * 7919 % length) div 1000 * 1000").alias("start"), F.col("l_quantity").cast("long").alias("q"))


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's end with the next line's of its order; the window partitioned by order needs no second shuffle."""
    w = Window.partitionBy("l_orderkey").orderBy("k")
    return _ends(spark, sf).select("*", F.lead("source").over(w).alias("source2"), F.lead("start").over(w).alias("start2")).filter("source2 IS NOT NULL")


def contact(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts between consecutive lines of an order."""
    return _neighbours(spark, sf).select(F.col("source").alias("source1"), F.col("start").alias("start1"), "source2", "start2", F.col("q").alias("count"))


def cov(spark: SparkSession, sf: str) -> DataFrame:
    """A coverage record for each line."""
    joined = table(spark, sf, "lineitem").join(contig(spark, sf), F.col("l_partkey") == F.col("source_id"))
    return joined.select(F.col("l_partkey").alias("chrom"), F.expr("l_orderkey * 131 % length").alias("start"), F.expr("least(l_orderkey * 131 % length + 500, length)").alias("end"), F.col("l_quantity").alias("value"))


def paf(spark: SparkSession, sf: str, ids: bool = True) -> DataFrame:
    """An alignment for each line, of a part's contig to a supplier's sequence; without ``ids``, which need each line's number in its order, no line is shuffled."""
    lines = _lines(spark, sf) if ids else table(spark, sf, "lineitem").withColumn("k", F.lit(None))
    joined = lines.join(contig(spark, sf), F.col("l_partkey") == F.col("source_id"))
    base = joined.select(
        (F.col("l_orderkey") * 100 + F.col("k")).alias("aln_id"), F.col("l_partkey").alias("query_name"), F.col("l_suppkey").alias("target_name"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.col("length").alias("query_len"), F.expr("l_orderkey * 131 % length").alias("query_start"), F.expr("least(l_orderkey * 131 % length + 200 + cast(l_quantity as bigint) * 100, length)").alias("query_end"),
        F.expr("l_orderkey * 517 % 1000000").alias("target_start"), "l_linenumber",
    )
    span = F.col("query_end") - F.col("query_start")
    return base.select(*["aln_id"] * ids, "query_name", "target_name", "strand", "query_len", "query_start", "query_end", "target_start", (F.col("target_start") + span).alias("target_end"), F.expr("(query_end - query_start) * (80 + l_linenumber) div 100").alias("matches"), span.alias("block_len"), (F.col("l_linenumber") * 8).cast("int").alias("mapq"))


def chrom(spark: SparkSession, sf: str) -> DataFrame:
    return contig(spark, sf).select(F.col("source_id").alias("chrom_id"), "length")


def pixel(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts as pixels of 1,000-base bins that restart at each contig."""
    sized = chrom(spark, sf).withColumn("n", F.expr("length div 1000"))
    base = total_before(sized, "chrom_id", "n", "base").select("chrom_id", F.col("base").cast("long").alias("base"))
    one, two = base.select(F.col("chrom_id").alias("source1"), F.col("base").alias("b1")), base.select(F.col("chrom_id").alias("source2"), F.col("base").alias("b2"))
    binned = contact(spark, sf).join(one, "source1").join(two, "source2").select(F.expr("b1 + start1 div 1000").alias("i"), F.expr("b2 + start2 div 1000").alias("j"), "count")
    return binned.groupBy(F.least("i", "j").alias("bin1_id"), F.greatest("i", "j").alias("bin2_id")).agg(F.sum("count").alias("count"))


def glink(spark: SparkSession, sf: str) -> DataFrame:
    """Graph links between the contigs of consecutive lines."""
    side = lambda c: F.when(F.expr(f"{c} div 1000 % 2") == 0, "start").otherwise("end")
    rows = _neighbours(spark, sf).filter("source <> source2")
    return rows.select((F.col("l_orderkey") * 100 + F.col("k")).alias("line_no"), F.col("source").alias("from_segment"), side("start").alias("from_side"), F.col("source2").alias("to_segment"), side("start2").alias("to_side"), F.when(F.col("q") % 3 == 0, "*").otherwise(F.concat(F.col("q").cast("string"), F.lit("M"))).alias("overlap"), F.col("q").alias("bases"))
