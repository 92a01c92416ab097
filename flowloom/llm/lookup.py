"""Lookups by key where a few keys may own most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .common import stored


def looked_up(left: DataFrame, right: DataFrame, keys: Sequence[str], share: int = 2000) -> DataFrame:
    """``left`` with the columns of ``right``'s row of the same keys, or nulls.

    ``right`` has one row per key; both sides are stored frames. Fewer than ``share`` keys can own more
    than a ``share``-th of the rows of ``left``: their rows of ``right`` are broadcast, all others meet
    in a shuffle, where no key is large. Keys are not null.
    """
    keys = list(keys)
    often = left.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > left.count() / share)
    few = F.broadcast(stored(often.drop("n"), "often"))
    usual = left.join(few, keys, "left_anti").join(right, keys, "left")
    hot = left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys, "left")
    return usual.unionByName(hot)
