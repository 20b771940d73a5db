"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, or the node if that is smaller."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, are linked to the smallest of them."""
    near = _least(links)
    rest = links.join(near, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links(a, b); nodes without links are absent.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round. Links never
    reach the driver; a round ends the loop when count and hash of the links stay the same. Self-links and repeats don't
    matter; an empty table gives an empty one.
    """
    now = spill(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        now = spill(_small_star(_large_star(now)), "links")
