"""Connected components of large graphs, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours move to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a > b, long): root is the least node of its component.

    Alternates the two steps until the edges form stars, in a number of rounds that grows with the logarithm of the
    number of nodes. Each round is written to the shared folder, so no lineage builds up and nothing comes to the driver but
    a count and a checksum; the round before goes when the next is written."""
    edges = staged(edges.select("a", "b").filter("a > b").distinct(), "edges")
    before = None
    while True:
        sign = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sign == before or sign.n == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, last = sign, edges
        edges = staged(_small_star(_large_star(last).distinct()).distinct(), "edges")
        dropped(last)
