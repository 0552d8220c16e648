"""Connected components of a graph of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

ROWS = 200_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Points each neighbour of a node (greater ones if large, else it and the lesser ones) to the least of the node's group."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(both.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node with a link (a, b) whose component has a lesser node; the component is the least.

    Links may repeat, run either way, or join a node to itself. An empty frame gives an empty one. A node with a third of all links is an
    aggregation key and the larger side of a join, which Spark splits; no group is ever collected.
    """
    fit = lambda frame, rows: frame.coalesce(max(1, math.ceil(rows / ROWS)))  # noqa: E731  few files for few links, whatever the session's partitions
    now = staged(fit(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), links.count()))
    mark = None
    while True:
        count, *sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first()
        if count == 0 or mark == (count, *sums):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = (count, *sums)
        now = staged(fit(_star(_star(now, True), False), count))
