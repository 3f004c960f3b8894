"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_unique, materialize


def _towards_least(edges: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """edges (a, b) with least: the smallest b of each a, a hot a dealt out; and the table of those."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("w")), "components-least")
    return join_unique(edges, least, "a", "w", count, least.count()), least


def _are_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("below"))
    return not ends.where("up > 1 OR up = 1 AND below = 0").take(1)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a long, b long), a row each.

    Large star: each node joins its larger neighbours to its smallest one. Small star: each node joins its
    smaller neighbours and itself to the smallest. Repeated until there are only stars: no round for edges
    that are, a few for near copies. Only longs shuffle, nothing is gathered in one place; a round's tables
    go when the next is written.
    """
    up = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = materialize(up, "components")
    while not _are_stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, least = _towards_least(both, 2 * now.count())
        large = large.where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
        large = materialize(large.where("a > b").distinct(), "components-large")
        small, lower = _towards_least(large, large.count())
        small = small.select("a", F.col("least").alias("b")).union(small.select(F.col("b").alias("a"), F.col("least").alias("b")))
        before, now = now, materialize(small.where("a > b").distinct(), "components")
        drop(before, least, large, lower)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
