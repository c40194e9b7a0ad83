"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.session import stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node of these edges (a > b) has two smaller neighbours, or a smaller and a larger one; if not, all are stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(each.agg(F.bool_or((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).head()[0])


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, root): every node on an edge with the smallest node of its component.

    Each step replaces the edges by as many or fewer, staged as a table, until they are stars around the smallest nodes; the
    number of steps grows with the logarithm of the longest path, and edges that are stars already need none. A hub's edges are
    only joined with one smallest neighbour, never gathered. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                "edges")
    while _unfinished(now):
        # Large star: larger neighbours of a node go to the smallest one around it.
        around = _both(now)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stage(around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .where("a <> b"), "edges")
        # Small star: a node and its smaller neighbours go to the smallest of them. Edges point from large to small.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        now = stage(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                    .union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
