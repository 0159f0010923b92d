"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def _is_stars(e: DataFrame) -> bool:
    """Does every node of ``e`` (a < b) hang on one ``a`` that itself hangs on none?"""
    at = e.select(F.col("b").alias("x"), F.col("a").alias("m")).union(e.select("a", "a"))
    return at.groupBy("x").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).filter("lo <> hi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; the label is the least node of the
    component.  Every step is an aggregate and a join over the edges (a node with many
    edges is pre-aggregated, then split by the skew join); each round is checkpointed and
    the loop ends when the edges are stars, which costs one aggregate to see."""
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .filter("a <> b").distinct())
    while not _is_stars(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = (both.join(low, F.col("u") == F.col("c")).filter("v > u and v <> m")
                 .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("c"), "m")
        small = large.join(least, F.col("b") == F.col("c"))
        e = materialize(small.filter("a <> m").select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b"))
                        .union(least.select("m", "c")).distinct())
    return e.select(F.col("b").alias("node"), F.col("a").alias("label")).union(
        e.select("a", "a").distinct())
