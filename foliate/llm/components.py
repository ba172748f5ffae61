"""Connected components by alternating large and small stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` but the roots; root is the component's smallest node.

    Both columns have one ordered type without nulls; loops and repeated edges
    are harmless and an empty table gives none. Each round links every node to
    the smallest of its neighbours (large star, then small star) and writes the
    edges to the shared folder; it ends when they no longer change. Minima are
    written before they are joined, so that a join's side with one hot node is
    a plain shuffle, which adaptive execution splits.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    known = None
    for _ in range(rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == known or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        known = tuple(state)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        drop(e, least)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        down = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(down.union(least).distinct())
        drop(large, least)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
