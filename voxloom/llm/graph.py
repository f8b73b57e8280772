"""Connected components over Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.scratch import removed, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of ``edges`` (a, b); the component is its smallest id.

    Each round takes the smallest label among the neighbours and then the label of that label, until
    nothing changes; every round is a written table. Labels only fall, so this ends.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = saved(both, "cc-edges")
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "cc-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        new = step.join(jump, F.col("low") == F.col("via"), "left").select("id", F.least("low", "far").alias("new"), "label")
        new = saved(new, "cc-labels")
        removed(labels)
        labels = new.select("id", F.col("new").alias("label"))
        if new.where("new <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
