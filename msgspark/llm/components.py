"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Root of every node that has a link: columns (node, root); root is the least node reached.

    ``edges`` has columns (a, b). Each round points every node to its least neighbour
    and on to that one's choice, then replaces nodes by what they point to. Rounds
    grow with the logarithm of the longest chain. Hubs are pre-aggregated before the
    shuffle and joins are plain equi-joins that Spark can split; each round is
    written to the shared folder.
    """
    edges = scratch.write(edges.where("a <> b").distinct(), "edges")
    labels = scratch.write(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        .withColumn("root", F.col("node")),
        "labels",
    )
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("p"))
        point = scratch.write(
            least.select(F.col("a").alias("node"), F.least("a", "p").alias("p")), "point"
        )
        second = point.select(F.col("node").alias("p"), F.col("p").alias("to"))
        hop = scratch.write(point.join(second, "p").select("node", "to"), "hop")
        shorter = (
            edges.join(hop.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(hop.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        shorter = scratch.write(shorter, "edges")
        moved = (
            labels.join(hop.select(F.col("node").alias("root"), "to"), "root", "left")
            .select("node", F.coalesce("to", "root").alias("root"))
        )
        moved = scratch.write(moved, "labels")
        scratch.drop(edges, labels, point, hop)
        edges, labels = shorter, moved
    scratch.drop(edges)
    return labels
