"""Connected components of a graph too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge, root being the least node it reaches.

    ``edges`` has long columns ``a, b``, in any direction, with repeats or loops. Alternates two steps
    until nothing changes: every node's larger neighbours are tied to the least of its neighbourhood,
    then its smaller ones. Each step is an aggregate and a join, so a node with very many neighbours
    is never gathered in one place; every round is written down.
    """
    down = lambda df, a, b: df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    now, seen = stored(down(edges, "a", "b"), "edges"), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
        large = down(both.where("b > a").join(least, F.col("a") == F.col("of")).select("b", "m"), "b", "m")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
        small = large.join(least, F.col("a") == F.col("of")).select("b", "m").union(least.select("of", "m"))
        now = stored(down(small, "b", "m"), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
