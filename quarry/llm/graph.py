"""Connected components of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``a``, ``b`` of any orderable type -> node, component (its least node), for linked nodes.

    Each round every node takes the least label around it, then the label of its label, so
    the number of rounds grows with the logarithm of the longest chain.  Nothing but a
    flag goes to the driver.  A node with very many links meets them in a join that Spark
    splits; its own label leaves each task once, by map-side aggregation.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b"))
    edges = materialize(both, "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("m"))
        least = labels.join(near, F.col("node") == F.col("n")).select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        least = materialize(least, "least")
        up = least.select(F.col("node").alias("n"), F.col("component").alias("top"))
        jumped = least.join(up, F.col("component") == F.col("n")).select("node", F.least("component", "top").alias("component"), "was")
        jumped = materialize(jumped, "labels")
        discard(labels)
        discard(least)
        labels = jumped.select("node", "component")
        labels._quarry_path = jumped._quarry_path
        if jumped.where(F.col("component") != F.col("was")).isEmpty():
            discard(edges)
            return labels
