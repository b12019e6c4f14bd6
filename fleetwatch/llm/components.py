"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """Columns node, label (the least node reachable) for every node of ``edges`` (a, b).

    Labels spread to neighbours and then jump to the label's own label, so long chains
    need few rounds. Each round is a written table; only its count of changes comes to the
    driver. A node with very many edges is met by partial aggregation and by joins that
    adaptive execution splits.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.filter("a != b").distinct()).df
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))).df
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        own = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = own.join(jump, "label").select("node", F.least("label", "further").alias("label"), "old")
        step = materialise(moved.withColumn("moved", (F.col("label") != F.col("old")).cast("int")), largest="moved")
        labels = step.df.select("node", "label")
        if not step.largest:
            return labels
