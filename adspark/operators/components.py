"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable. NULL ends are dropped, self-loops keep their node.

    Smallest labels spread along the edges while pointers jump: every round a node takes the smallest label among its
    neighbours and then the label of the node so named. Rounds grow with the logarithm of the longest path, each joins all
    edges with the labels, and no neighbourhood is gathered: only minima are, combined map-side. Every round is checkpointed,
    so a lost executor repeats one round.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    label = cut(nodes.withColumn("component", F.col("node")))
    both = cut(given.where("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct())
    for _ in range(most_rounds):
        # The smallest label among the neighbours, then the label of that label (pointer jumping).
        near = both.join(label.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("least"))
        hung = label.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = hung.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut(hung.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        if new.where("old <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
