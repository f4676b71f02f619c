"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefloom.llm.common import Stages


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (or the not larger) neighbours of every node to the smallest of all."""
    around = _both(edges)
    near = around if large else around.where("y < x")
    least = near.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
    joined = near.join(least, "x")
    if large:
        linked = joined.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    else:
        linked = joined.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y")))
    return linked.where("x <> y").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, on which nothing but leaves hang: by one count, combined before its shuffle."""
    ends = edges.selectExpr("x AS node", "1 AS up", "0 AS down").unionByName(edges.selectExpr("y AS node", "0 AS up", "1 AS down"))
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where("up > 1 OR (up = 1 AND down = 1)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """``x, y`` -> ``node, root``: the smallest node of each component, for nodes with an edge.

    Alternating stars: edges are hung on smaller and smaller nodes until every
    component is one star; edges that are stars from the start are not hung at
    all.  Each half of a round is written, so a plan holds one star and nothing
    is computed for each of its readers; it is no larger than the edges, and a
    node with a large share of all edges is one row of the aggregate and a join
    that adaptive execution can split.
    """
    edges = stages.write(f"{name}-0", edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    n = 0
    while not _stars(edges):
        n += 1
        hung = stages.write(f"{name}-{n}-large", _star(edges, True))
        edges = stages.write(f"{name}-{n}", _star(hung, False))
        stages.drop(f"{name}-{n}-large", f"{name}-{n - 1}")
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
