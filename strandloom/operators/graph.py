"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every end of the edges ``a``, ``b``.

    Each round takes the least label among a node and its neighbours and then the label of that label, so that
    distances to the least node about halve; a written table cuts the lineage of each round. Only the number of
    changed labels reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        fresh = materialise(stepped.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("component")), "labels")
        changed = fresh.filter("component <> old").limit(1).count()
        labels = fresh.select("node", "component")
        if not changed:
            return labels
