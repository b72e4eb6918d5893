"""Assembly graphs against the layout: nodes, unambiguous links, adjacencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def graph_nodes(segments: DataFrame, layout: DataFrame) -> DataFrame:
    """A node for every placement of a segment, and one for each segment without any; occurrences counts placements."""
    placed = segments.join(layout, segments["name"] == layout["source_id"]).select("name", "block_id", "object_id")
    lone = segments.join(layout, segments["name"] == layout["source_id"], "left_anti").select("name", F.lit(None).cast("long").alias("block_id"), F.lit("Unplaced").alias("object_id"))
    return placed.withColumn("occurrences", F.count(F.lit(1)).over(Window.partitionBy("name"))).unionByName(lone.withColumn("occurrences", F.lit(0).cast("long")))


def unique_links(links: DataFrame) -> DataFrame:
    """One row for each unordered pair of ends and overlap: the one that comes first in the file."""
    ends = F.array_sort(F.array(F.struct(F.col("from_segment").alias("n"), F.col("from_side").alias("s")), F.struct(F.col("to_segment").alias("n"), F.col("to_side").alias("s"))))
    keyed = links.withColumn("_key", ends)
    return keyed.withColumn("_k", F.row_number().over(Window.partitionBy("_key", "overlap").orderBy("line_no"))).filter("_k = 1").drop("_key", "_k")


def placed_links(links: DataFrame, layout: DataFrame) -> DataFrame:
    """Links of which both segments stand exactly once in the layout, with their blocks."""
    single = layout.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("block_id").alias("block_id")).filter("n = 1")
    a, b = single.select(F.col("source_id").alias("from_segment"), F.col("block_id").alias("from_block")), single.select(F.col("source_id").alias("to_segment"), F.col("block_id").alias("to_block"))
    return links.join(a, "from_segment").join(b, "to_segment")


def adjacency(layout: DataFrame) -> DataFrame:
    """block_id and the next block of its object with the gap between them."""
    w = Window.partitionBy("object_id").orderBy("visual_start")
    return layout.select("object_id", "block_id", F.lead("block_id").over(w).alias("next_id"), (F.lead("visual_start").over(w) - F.col("visual_end")).alias("gap")).filter("next_id IS NOT NULL")


def verified_overlap(links: DataFrame, segments: DataFrame) -> DataFrame:
    """from_overlap_bases where the overlap is one exact run and the segment's length less the link's L1 equals it."""
    bases = F.regexp_extract("overlap", "^([0-9]+)M$", 1).try_cast("long")
    sized = links.join(segments.select(F.col("name").alias("from_segment"), "length"), "from_segment", "left")
    return sized.withColumn("from_overlap_bases", F.when(F.col("length") - F.col("l1") == bases, bases)).drop("length")
