"""Connected components by repeated hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Returns (node, component) for every node of edges (a, b), component being its smallest node.

    Each round hooks every node to its smallest neighbour (a partially aggregated minimum,
    so a node with very many edges is no hot group), shortens the resulting trees by pointer
    jumping, and replaces the edges' ends by their roots. Non-minimal nodes vanish in every
    round, so the rounds grow with the logarithm of the nodes. Nothing but row counts
    reaches the driver. Null ends and self loops are ignored; an empty input gives no row.
    """
    left = materialize(edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hook")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialize(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jump")
            moved = not jumped.where("moved").isEmpty()
            up = jumped.select("node", "root")
            if not moved:
                break
        if labels is None:
            labels = up.select("node", F.col("root").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), "root")
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        ends_a, ends_b = (up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        left = materialize(left.join(ends_a, "a").join(ends_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
