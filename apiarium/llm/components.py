"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiarium.scratch import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return moved.union(low.select("a", F.col("low").alias("b")))


def _stars(links: DataFrame) -> bool:
    """Is every component a star around its least node? Links run from the greater node a to the lesser b."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return ends.filter("up + low > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links (a, b) reach, for every node that has a link.

    Each node's neighbours meet only as partial minima, so a hub is never gathered; the
    number of rounds grows with the logarithm of the number of nodes. No link: no row.
    """
    links = materialize(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a <> b").distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while not _stars(links):
        stars = materialize(_small_star(_large_star(links)).distinct(), "stars")
        discard(links)
        links = stars
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
