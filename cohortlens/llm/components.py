"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node it can reach.

    Each round takes the smallest label around a node (summed up on the map side, so a node with
    very many edges costs one row per task) and then the label's own label, which at least halves what is
    left of a path.  Labels are written to the shared folder each round."""
    both = written(edges.select("a", "b").where("a <> b").distinct()
                   .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
                   .select(F.col("e.a").alias("node"), F.col("e.b").alias("other")), "edges", few=True)
    labels = written(both.groupBy("node").agg(F.min("other").alias("m"))
                     .select("node", F.least("node", "m").alias("label")), "labels", few=True)
    for _ in range(MAX_ROUNDS):
        near = (both.join(labels.select(F.col("node").alias("other"), "label"), "other")
                .groupBy("node").agg(F.min("label").alias("m")))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = written(step.join(up, "label", "left")
                      .select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old"), "labels", few=True)
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError("components did not settle")
