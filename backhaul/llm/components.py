"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.llm.scratch import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low)


def components(edges: DataFrame) -> DataFrame:
    """`node` and its `root`, the smallest node it is connected with, for all nodes but the roots.

    `edges` has the columns a and b, of one orderable type; loops are ignored. Minima are combined
    before shuffles and star joins may be split, so a node may have any number of neighbours. Each
    step is written to scratch; the number of steps grows with the logarithm of the longest path.
    """
    def step(df: DataFrame) -> DataFrame:
        return stored(_small_star(_large_star(df)).distinct(), "edges")

    now = step(edges.where("a != b").select("a", "b"))
    while True:
        # Done when the edges are stars: no node is both an end and a centre, none has two centres.
        centres = now.select(F.col("b").alias("a"), F.lit(1).alias("centre"))
        ends = now.select("a", F.lit(0).alias("centre"))
        kinds = centres.union(ends).groupBy("a").agg(F.sum("centre").alias("centres"), F.count("*").alias("n"))
        chained = kinds.where("(centres > 0 and centres < n) or (centres = 0 and n > 1)")
        larger = now.where("a < b").select("a")
        if chained.select("a").union(larger).isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = step(now)
