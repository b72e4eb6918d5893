"""AGP text: strict and lenient readers, summary, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_COLUMNS = ["object_id", "object_beg", "object_end", "part_number", "component_type", "c6", "c7", "c8", "c9"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no of a text file (gzip by its suffix). One file is one ordered list, so its lines are read as one row."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")).select((F.col("line_no") + 1).cast("long").alias("line_no"), "value")


def agp_rows(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """Rows of nine columns; others raise, or are skipped if lenient. Comments and blank lines are no rows."""
    rows = lines.filter(~F.col("value").rlike("^\\s*(#|$)")).withColumn("c", F.split("value", "\t"))
    good = (F.size("c") == 9) & F.col("value").rlike("^[^\t]+\t[0-9]+\t[0-9]+\t[0-9]+\t[A-Za-z]\t")
    rows = rows.filter(good) if lenient else rows.withColumn("c", F.when(good, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("bad AGP row: "), F.col("value"))).cast("array<string>")))
    return rows.select("line_no", *[F.get("c", i).alias(name) for i, name in enumerate(_COLUMNS)])


def layout_of(rows: DataFrame) -> DataFrame:
    """Components as a layout; a gap row becomes the gap before the next component. Block ids follow the lines."""
    gap = F.col("component_type").isin("N", "U")
    w = Window.partitionBy("object_id").orderBy("line_no")
    before = F.sum(F.when(gap, F.col("c6").cast("long")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("_gaps", F.coalesce(before, F.lit(0)))
    parts = placed.filter(~gap).withColumn("_was", F.coalesce(F.lag("_gaps").over(w), F.lit(0)))
    return parts.select(
        F.col("line_no").alias("block_id"), "object_id", F.col("c6").alias("source_id"), (F.col("c7").cast("long") - 1).alias("source_start"), F.col("c8").cast("long").alias("source_end"),
        F.col("c9").alias("orientation"), (F.col("_gaps") - F.col("_was")).alias("gap_before"), F.col("line_no").alias("ord"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """lines, objects, components, gaps and the greatest object end."""
    gap = F.col("component_type").isin("N", "U")
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("object_id").alias("objects"), F.sum((~gap).cast("long")).alias("components"), F.sum(gap.cast("long")).alias("gaps"), F.max(F.col("object_end").cast("long")).alias("span"))


def export_rows(layout: DataFrame) -> DataFrame:
    """AGP rows of a layout: a gap row before each block but an object's first, 1-based closed coordinates, part numbers."""
    w = Window.partitionBy("object_id").orderBy("ord")
    first = F.row_number().over(w) == 1
    gap = F.struct(F.lit(0).alias("kind"), F.col("gap_before").alias("length"), F.lit("U").alias("component_type"), F.col("gap_before").cast("string").alias("component"), F.lit("contig").alias("component_beg"), F.lit("no").alias("component_end"), F.lit("na").alias("orientation"))
    part = F.struct(F.lit(1).alias("kind"), (F.col("source_end") - F.col("source_start")).alias("length"), F.lit("W").alias("component_type"), F.col("source_id").cast("string").alias("component"), (F.col("source_start") + 1).cast("string").alias("component_beg"), F.col("source_end").cast("string").alias("component_end"), F.col("orientation").alias("orientation"))
    rows = layout.withColumn("_first", first).withColumn("r", F.explode(F.when(F.col("_first") | (F.col("gap_before") <= 0), F.array(part)).otherwise(F.array(gap, part))))
    inner = Window.partitionBy("object_id").orderBy("ord", "r.kind")
    ended = rows.withColumn("object_end", F.sum("r.length").over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("part_number", F.row_number().over(inner))
    return ended.select("object_id", (F.col("object_end") - F.col("r.length") + 1).alias("object_beg"), "object_end", F.col("part_number").cast("long").alias("part_number"), "r.component_type", "r.component", "r.component_beg", "r.component_end", "r.orientation", "ord", F.col("r.kind").alias("kind"))


def write_agp(layout: DataFrame, path: str) -> None:
    """AGP text in the order of the blocks."""
    rows = export_rows(layout).orderBy("ord", "kind")
    rows.select(F.concat_ws("\t", "object_id", "object_beg", "object_end", "part_number", "component_type", "component", "component_beg", "component_end", "orientation").alias("value")).coalesce(1).write.text(path)
