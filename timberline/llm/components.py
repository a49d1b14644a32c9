"""Connected components of links as Spark jobs: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import hot_join, keep


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node that a linked node reaches, for all but that node itself.

    A step groups neighbours only by their minimum, and the nodes with the most
    neighbours get theirs by broadcast, so no neighbourhood is gathered in one
    place. The number of steps grows with the logarithm of the
    longest path. Neither links nor components reach the driver.
    """
    edges = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # Large star: every larger neighbour is tied to the smallest of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = hot_join(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # Small star: every smaller neighbour, and the node, is tied to the smallest.
        large = keep(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = hot_join(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(tied.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        before = now
