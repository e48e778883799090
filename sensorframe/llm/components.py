"""Connected components of a graph of integer nodes, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.tables import stored

MAX_ROUNDS = 100


def _towards_smallest(pairs: DataFrame, keep) -> DataFrame:
    """Point the neighbours of every node, and the node, at the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").select(*keep)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a bigint, b bigint)``; root is the smallest node reachable.

    Each round points the larger neighbours of every node at its smallest neighbour
    (large star) and then the node and its smaller neighbours (small star), until
    all edges lead to roots. Rounds grow with the logarithm of the graph. The edges
    of each round are written to the shared folder, which cuts the lineage.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct()
            )
        before = tuple(mark)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = _towards_smallest(both, [F.col("v").alias("a"), F.col("m").alias("b"), (F.col("v") > F.col("u")).alias("up")])
        large = large.filter("up and a <> b").select("a", "b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = stored(small.filter("a <> b").union(least.select("u", "m")).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
