"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours of the smallest node it knows."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node tells its smaller neighbours, and itself, of the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    told = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return told.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node) for every node of a link between two different nodes.

    Takes a number of rounds that grows with the logarithm of the longest chain; each is written to the
    shared folder, so nothing is computed twice when an executor is lost.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "components")
    while True:
        total = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        after = stored(_small_star(_large_star(edges).distinct()).distinct(), "components")
        if total(edges) == total(after):
            break
        edges = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
