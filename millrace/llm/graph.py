"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """v and label (the smallest vertex of its component) of each vertex of edges (a, b).

    Labels spread over the edges and jump to the label of their label, so the
    number of rounds follows the logarithm of a component's diameter. A hub
    meets aggregations, which combine on the map side, and joins with one row
    for each vertex, whose large partitions Spark splits.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = shared.stored(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = shared.stored(both.groupBy(F.col("u").alias("v")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("above"))
        step = shared.stored(step.join(up, "label", "left").select("v", "old", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        labels = step.select("v", "label")
        if step.where("old <> label").isEmpty():
            return labels
