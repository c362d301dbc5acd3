"""Connected components of an edge table by alternating large-star and small-star steps.

Each step takes the minimum over a node's neighbours (partial sums come before the shuffle) and joins it back, where
the adaptive plan splits the rows of a hub. Every round is written to the shared folder, so lineage stays short and
a lost executor costs a task, not the loop. Nothing but a number a round reaches the driver, and no round is spent on
finding that nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixmill.llm.common import forget, written


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    return down.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))


def _unsettled(e: DataFrame) -> int:
    """How many nodes have two edges down, or one down and one up. Without any, each component is a star around its smallest node."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return nodes.where("down > 1 or down > 0 and least = 0").count()


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) long. Returns (node, root) for every node of an edge other than roots; root is the smallest node
    reachable. Loops and repeated edges are allowed; no edges give no rows."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while _unsettled(e):
        new = written(_small(_large(e)).where("u <> v").distinct(), "links")
        forget(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
