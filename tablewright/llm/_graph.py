"""Connected components with joins: smallest label of the neighbours, then the label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm._shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node of it) of every node that has an edge. Each round is stored, so a
    lost executor costs one round; only a count comes to the driver."""
    pair = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = stored(pair.unionByName(pair.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        hooked = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = stored(hooked.join(above, "label", "left").select("node", "was", F.least("label", "above").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label <> was").limit(1).count():
            return labels.withColumnRenamed("label", "component")
