"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each round hangs every node below its smallest smaller neighbour, shortens the chains
    to their roots, and replaces the edges by edges between roots. Nodes that hang vanish
    from the edges, so the table shrinks each round and hubs need no list of neighbours.
    """
    edges = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    labels = scratch.cut(edges.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("comp", F.col("node")))
    while not edges.isEmpty():
        up = scratch.cut(edges.groupBy("hi").agg(F.min("lo").alias("root")))
        while True:  # pointer jumping halves the chains
            over = up.select(F.col("hi").alias("root"), F.col("root").alias("next"))
            longer = scratch.cut(up.join(over, "root", "left").select("hi", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            done = longer.where("moved").isEmpty()
            scratch.drop(up)
            up = longer
            if done:
                break
        move = up.select(F.col("hi").alias("from"), "root")
        shifted = labels.join(move, labels["comp"] == move["from"], "left").select("node", F.coalesce("root", "comp").alias("comp"))
        rest = edges.join(move.withColumnsRenamed({"from": "hi", "root": "h"}), "hi", "left").select(F.coalesce("h", "hi").alias("x"), "lo")
        rest = rest.join(move.withColumnsRenamed({"from": "lo", "root": "l"}), "lo", "left").select("x", F.coalesce("l", "lo").alias("y"))
        rest = rest.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()
        new_labels, new_edges = scratch.cut(shifted), scratch.cut(rest)
        scratch.drop(labels, edges, up)
        labels, edges = new_labels, new_edges
    return labels
