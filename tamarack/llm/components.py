"""Connected components by minimum labels with pointer jumping, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable over the undirected edges.

    Each round takes the least label among neighbours, then follows labels of labels, so rounds grow with the logarithm
    of the longest path. Both sides of each join are written tables behind plain exchanges, so adaptive execution can
    split a hub's rows. Nodes without an edge don't appear; an empty input gives an empty result.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v and u is not null and v is not null")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("near"))
        near = materialize(near, "near")
        far = near.select(F.col("node").alias("near"), F.col("near").alias("beyond"))
        step = near.join(far, "near", "left").select("node", "was", F.least("near", "beyond").alias("label"))
        step = materialize(step, "labels")
        labels = step.select("node", "label")
        if step.filter("label <> was").limit(1).count() == 0:
            return labels
