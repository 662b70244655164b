"""Connected components of an edge table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import stored


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node here."""
    low = e.groupBy("a").agg(F.min("b").alias("low"))
    near = e.join(low, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return near.union(low.select("a", F.col("low").alias("b"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most and no chain is left."""
    ends = e.selectExpr("a AS node", "1 AS up", "0 AS down").union(e.selectExpr("b", "0", "1"))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return odd.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (a, b).

    Each round is stored in the shared folder. A hub's neighbours are reduced by partial
    aggregation, and the joins are plain equi-joins that adaptive execution splits by skew."""
    e = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
               "edges")
    while not _stars(e):
        e = stored(_small(_large(e)), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
