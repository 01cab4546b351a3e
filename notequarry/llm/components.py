"""Connected components of a graph given as links, each named by its least node.

Large-star and small-star steps in turn, as DataFrames written to the shared folder after each round. A large-star step
links each node's larger neighbours to the least one; a small-star step links the smaller ones, and the node itself, to
the least. Both keep the components, and the number of links never grows. The rounds end when a round changes nothing.
A hot node is a hot key of a partial aggregation and of joins that Spark can split, never a collected list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    smaller = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; links: (a, b), nulls and loops don't count."""
    links = links.where("a is not null and b is not null and a != b")
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        links = stored(star(star(links, True).where("a != b").distinct(), False).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = now
