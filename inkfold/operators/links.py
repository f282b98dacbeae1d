"""Components of links between values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stored import settled


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest value that each linked value reaches; ``links`` are rows of ``a, b``.

    Each round points values at the smallest neighbour of their own (large star) and
    their smaller ones at each other's (small star), by joins and partial aggregates.
    """
    edges = settled(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    before = None
    for _ in range(rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(edges.select("a", "a").distinct()).groupBy("node").agg(F.min("root").alias("root"))
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = settled(small.union(low.select(F.col("m").alias("a"), "b")).distinct(), "links")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
