"""PAF and bedGraph text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file or folder; .gz is unpacked by its suffix. Order doesn't matter to what reads them."""
    return spark.read.text(path)


def _checked(good: Column, value: Column, line: str, what: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"bad {what}: "), F.col(line))).cast("array<string>"))


def paf(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """Alignments with their tags as a map; the first tp tag gives the type. Bad rows raise, or are skipped if lenient.

    At least twelve columns between white space, a strand of + or -, integers where the format has them, and a mapq
    of at most 255.
    """
    rows = lines.filter(F.trim("value") != "").withColumn("c", F.split(F.trim("value"), "\\s+"))
    numbers = [1, 2, 3, 6, 7, 8, 9, 10, 11]
    good = (F.size("c") >= 12) & F.coalesce(F.get("c", F.lit(4)).isin("+", "-"), F.lit(False))
    for i in numbers:
        good = good & F.get("c", F.lit(i)).try_cast("bigint").isNotNull()
    good = F.coalesce(good & (F.get("c", F.lit(11)).try_cast("int") <= 255), F.lit(False))
    rows = rows.filter(good) if lenient else rows.withColumn("c", _checked(good, F.col("c"), "value", "PAF row"))
    number = lambda i: F.get("c", F.lit(i)).cast("long")
    tags = F.filter(F.slice("c", 13, F.greatest(F.size("c") - 12, F.lit(0))), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    first = F.aggregate(tags, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<type:string,value:string>>")), lambda m, t: F.when(F.map_contains_key(m, F.substring(t, 1, 2)), m).otherwise(F.map_concat(m, F.create_map(F.substring(t, 1, 2), F.struct(F.substring(t, 4, 1).alias("type"), F.regexp_replace(t, "^..:.:", "").alias("value"))))))
    kind = F.col("tags")["tp"]["value"]
    return rows.withColumn("tags", first).select(
        F.get("c", F.lit(0)).alias("query_name"), number(1).alias("query_len"), number(2).alias("query_start"), number(3).alias("query_end"), F.get("c", F.lit(4)).alias("strand"), F.get("c", F.lit(5)).alias("target_name"),
        number(6).alias("target_len"), number(7).alias("target_start"), number(8).alias("target_end"), number(9).alias("matches"), number(10).alias("block_len"), number(11).cast("int").alias("mapq"),
        F.when(kind == "P", "primary").when(kind == "S", "secondary").when(kind.isin("I", "i"), "inversion").otherwise("other").alias("alignment_type"), "tags",
    )


def bedgraph(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """chrom, start, end and value. Blank lines and comments are skipped; other bad rows raise, or are skipped if lenient.

    Lenient reading also skips track and browser lines and intervals that are negative or empty.
    """
    rows = lines.filter(~F.col("value").rlike("^\\s*(#|$)")).withColumn("c", F.split(F.trim("value"), "\\s+"))
    start, end, value = F.get("c", F.lit(1)).try_cast("bigint"), F.get("c", F.lit(2)).try_cast("bigint"), F.get("c", F.lit(3)).try_cast("double")
    good = F.coalesce((F.size("c") >= 4) & start.isNotNull() & end.isNotNull() & value.isNotNull() & (start >= 0) & (end > start), F.lit(False))
    rows = rows.filter(good & ~F.col("value").rlike("^\\s*(track|browser)\\b")) if lenient else rows.withColumn("c", _checked(good, F.col("c"), "value", "bedGraph row"))
    return rows.select(F.get("c", F.lit(0)).alias("chrom"), F.get("c", F.lit(1)).cast("long").alias("start"), F.get("c", F.lit(2)).cast("long").alias("end"), F.get("c", F.lit(3)).cast("double").alias("value"))
