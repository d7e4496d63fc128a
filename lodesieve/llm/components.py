"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("digest")).first()
    return row["n"], row["digest"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a vertex to the least of its neighbourhood."""
    both = edges.select(F.col("high").alias("x"), F.col("low").alias("y")).union(edges.select("low", "high"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.where("y > x").join(least, "x").select(F.col("y").alias("high"), F.col("m").alias("low")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the least of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    lower = edges.join(least, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return lower.union(least.select("high", F.col("m").alias("low"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for each vertex of the undirected edges (a, b) of longs; root: the least vertex of its component.

    Minima aggregate before they are shuffled, so a vertex with a third of all edges sends one row per task. Each round
    ends in a table of the shared folder; a logarithmic number of rounds suffices. Edges with a null or to themselves are
    ignored.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    before, state = None, _state(now)
    while state != before:
        now = saved(_small_star(_large_star(now)))
        before, state = state, _state(now)
    return now.select(F.col("high").alias("vertex"), F.col("low").alias("root")).union(
        now.select(F.col("low").alias("vertex"), F.col("low").alias("root")).distinct())
