"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import staged


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its smallest node), for every node on an edge.

    Each round a node takes the smallest label among its neighbours' and then
    the label of its label, so chains shrink by jumps.  Labels are written out
    after each round; only the number of changes comes to the driver.  Nodes
    with very many neighbours are safe: minima are taken before the shuffle.
    """
    both = staged(edges.select(F.col(src).alias("node"), F.col(dst).alias("other"))
                  .union(edges.select(F.col(dst), F.col(src))).where("node <> other").distinct(), "edges")
    labels = staged(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), "component"), "other")
                .groupBy("node").agg(F.min("component").alias("near")))
        low = (labels.join(near, "node")
               .select("node", F.col("component").alias("was"), F.least("component", "near").alias("low")))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        step = staged(low.join(jump, "low", "left")
                      .select("node", F.least("low", F.coalesce("root", "low")).alias("component"), "was"), "labels")
        changed = step.where("component <> was").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
