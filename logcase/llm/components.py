"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a partial aggregate (the smallest neighbour of each node) and an equi-join; edges never leave the
executors. Each round is written to the shared scratch folder, so that lost executors cost one round at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcase.plans.sizing import materialize


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Joins the neighbours of each node u to its smallest one: those above u (large star) or up to u (small star)."""
    both = edges.union(edges.select("v", "u")) if large else edges
    both = both.select(F.col("u").alias("x"), F.col("v").alias("y"))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    joined = both.join(least, "x")
    if large:
        out = joined.where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("x", "y")).alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node of its component."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    seen = None
    while True:
        edges = materialize(_step(_step(edges, True), False), "components")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v"), F.col("v")).distinct())
