"""Connected components of a table of links, by smallest label, without gathering any neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apisurface.llm.frames import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) for every node of ``links`` (``x``, ``y``, both long).

    Each round points every node at the smallest root among its neighbours' roots, then shortens the pointers; rounds
    grow with the logarithm of the longest path. Links inside a component are dropped as soon as they are known to be.
    State is written to the shared folder after each round. No links give no rows.
    """
    pairs = links.where(F.col("x") != F.col("y")).select("x", "y")
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    edges = stored(both, "links")
    labels = edges.groupBy("x").agg(F.min("y").alias("least"))
    labels = stored(labels.select(F.col("x").alias("node"), F.least("x", "least").alias("component")), "labels")
    while True:
        # Follow pointers: the label of a node's label.
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = stored(
            labels.join(target, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels"
        )
        at_x = labels.select(F.col("node").alias("x"), F.col("component").alias("cx"))
        at_y = labels.select(F.col("node").alias("y"), F.col("component").alias("cy"))
        crossing = stored(
            edges.join(at_x, "x").join(at_y, "y").where(F.col("cx") != F.col("cy")).select("x", "y", "cx", "cy"), "links"
        )
        roots = labels.where(F.col("node") == F.col("component")).count()
        pointers = labels.select("component").distinct().count()
        if crossing.isEmpty() and roots == pointers:
            return labels
        edges = crossing.select("x", "y")
        # A root takes the smallest root that a link of its component leads to.
        hooks = crossing.groupBy("cx").agg(F.min("cy").alias("least")).where(F.col("least") < F.col("cx"))
        hooks = hooks.select(F.col("cx").alias("component"), "least")
        labels = labels.join(hooks, "component", "left")
        labels = stored(labels.select("node", F.coalesce("least", "component").alias("component")), "labels")
