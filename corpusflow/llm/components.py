"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node has two parents, or is a parent and has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not seen.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges(u, v)`` but the components' smallest nodes.

    ``component`` is the smallest node reachable.  Each step is a minimum by
    node (combined before the shuffle) and a join that AQE can split; nothing
    but one answer per round reaches the driver.  Self-loops and repeated
    edges are ignored, null ends too; no edges give no rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    edges = materialize(edges.where("u is not null and v is not null").distinct(), "edges")
    while _unfinished(edges):
        stepped = materialize(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges = stepped
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
