"""Connected components of a table of links, by alternating large-star and small-star steps on DataFrames.

A step only groups links by a node and joins the smallest neighbour back, so no task holds a component and a node with
most of the links is a count and a skewed join. Every round is written to the shared folder, and the one before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour, itself included."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node (u > v) and its smaller neighbours are linked to the smallest of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    met = links.join(least, "u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component for every node with a link to another: the smallest node that it reaches. ``links`` has u and v, not null.

    The steps end by themselves: each brings nodes nearer to their smallest, and the first that changes nothing is the last.
    """
    now = staged(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark, last = _mark(now), None
    while mark[0] and mark != last:
        then, now = now, staged(_small_star(_large_star(now)), "links")
        discard(then)
        last, mark = mark, _mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
