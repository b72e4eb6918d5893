"""GFA text: segments, links and what reads support each segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(columns: str, name: str, kind: str) -> Column:
    """Value of the first NAME:kind: column, or null."""
    prefix = f"{name}:{kind}:"
    return F.regexp_replace(F.get(F.filter(F.col(columns), lambda t: F.startswith(t, F.lit(prefix))), F.lit(0)), f"^{prefix}", "")


def count_tag(columns: str, name: str) -> Column:
    """The integer tag if it is a whole number of at least 0."""
    return F.when(tag(columns, name, "i").rlike("^[0-9]{1,15}$"), tag(columns, name, "i").try_cast("bigint"))


def _records(lines: DataFrame, kind: str, columns: int) -> DataFrame:
    return lines.filter(F.startswith(F.col("value"), F.lit(f"{kind}\t"))).withColumn("c", F.split("value", "\t")).filter(F.size("c") >= columns)


def segments(lines: DataFrame) -> DataFrame:
    """name, length (LN beats the sequence), read_depth, has_sequence, reads and haplotype_counts; ``lines`` has value and line_no."""
    rows = _records(lines, "S", 3).select("line_no", "c", F.get("c", F.lit(1)).alias("name"), F.get("c", F.lit(2)).alias("sequence"))
    sized = rows.select("line_no", "name", F.coalesce(count_tag("c", "LN"), F.when(F.col("sequence") != "*", F.length("sequence").cast("long"))).alias("length"), count_tag("c", "rd").alias("read_depth"), (F.col("sequence") != "*").alias("has_sequence"))
    a = _records(lines, "A", 4).select(F.get("c", F.lit(1)).alias("name"), F.coalesce(tag("c", "HG", "A"), F.lit("")).alias("hap"))
    haps = a.groupBy("name", "hap").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(F.sum("n").alias("reads"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("hap", "n")))).alias("haplotype_counts"))
    return sized.join(haps, "name", "left").withColumn("reads", F.coalesce("reads", F.lit(0)))


def links(lines: DataFrame) -> DataFrame:
    """line_no, from and to segment with the side that the link leaves and enters, overlap and l1."""
    rows = _records(lines, "L", 6)
    out = lambda o: F.when(o == "+", "end").otherwise("start")
    into = lambda o: F.when(o == "+", "start").otherwise("end")
    c = lambda i: F.get("c", F.lit(i))
    return rows.filter(c(2).isin("+", "-") & c(4).isin("+", "-")).select("line_no", c(1).alias("from_segment"), out(c(2)).alias("from_side"), c(3).alias("to_segment"), into(c(4)).alias("to_side"), c(5).alias("overlap"), count_tag("c", "L1").alias("l1"))
