"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.session import settle


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is one node of the component.

    Each round points every node at its smallest neighbour and replaces both ends of every link by what they
    point at; links inside one point vanish. Nodes should be digests: over random names a round leaves a
    fraction of the nodes of any path, so the rounds grow with the logarithm of the longest one. Every round is written, so
    a lost executor costs a part of one round only.
    """
    links = settle(links.select("a", "b").filter("a <> b").distinct(), "links")
    roots = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node"))
    while not links.isEmpty():
        ends = links.union(links.select("b", "a"))
        points = settle(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "of"), "points")
        roots = settle(
            roots.join(points, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root")), "roots"
        )
        from_a = links.join(points, F.col("a") == F.col("of")).select(F.col("to").alias("a"), "b")
        moved = from_a.join(points, F.col("b") == F.col("of")).select("a", F.col("to").alias("b"))
        links = settle(moved.filter("a <> b").distinct(), "links")
    return roots
