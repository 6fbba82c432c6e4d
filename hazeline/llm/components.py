"""Connected components of a links table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.session import materialize


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """`node, component` for every node that has a link; the component is its smallest node.

    Every round, a node takes the smallest label beside it, then the label that
    its label has by now, so labels move twice as far each time. A round is
    written before the next one reads it. A node with very many links is one
    key of a join and of a minimum that each task takes of its own rows first.
    """
    one = links.select(links[a].alias("x"), links[b].alias("y")).where("x <> y")
    both = materialize(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("component").alias("m"))
        moved = labels.join(near, labels["node"] == near["x"]).select("node", "component", F.least("component", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        after = materialize(
            moved.join(jump, "next").select("node", F.col("component").alias("was"), F.least("next", "far").alias("component")), "labels"
        )
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
