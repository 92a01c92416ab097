"""Caps, samples, splits and unions that keep every class's exact size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .metrics import dominant_label
from .ordering import (
    MAX_GROUP_ROWS, _attach, bounded, hash_cuts, hash_position, hash_rank, hash_running_total,
    row_numbers,
)
from .selection import rows_between, value_cuts

_POSITION = "__position"
#: Bundles of tasks whose first rows are merged before the final rank.
FAN_IN = 256
#: Cap that stands for no cap.
UNCAPPED = 1 << 62


def _placed(df: DataFrame, position: Column | None, ids: Sequence[str], seed: int) -> DataFrame:
    return df.withColumn(_POSITION, hash_position(*ids, seed=seed) if position is None else position)


def _leading(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """Drop rows that cannot be among the first ``n`` of their key.

    Every task keeps its first ``n`` rows per key (Spark limits a row number
    before the shuffle), then each of ``FAN_IN`` bundles of tasks does. The
    bundle is fixed by the task, so a key of any size leaves at most
    ``FAN_IN * n`` rows.
    """
    bundled = df.withColumn("__bundle", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    w = Window.partitionBy(*keys, "__bundle").orderBy(*order)
    return bundled.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop(
        "__rn", "__bundle"
    )


def first_n(
    df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str] = ("seq",),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The first ``n`` rows of every key in order."""
    return slice_rows(df, 0, n, order, keys, max_rows)


def first_n_by_source(
    df: DataFrame, catalogue: DataFrame, source: str = "file", order: Sequence[str] = ("seq",),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Keep catalogued sources up to their own ``cap``; adds the source's ``class``.

    A cap of ``UNCAPPED`` or more keeps a source whole, without ranking it.
    """
    listed = df.join(bounded(catalogue.select(source, "class", "cap")), source)
    largest = catalogue.where(F.col("cap") < UNCAPPED).agg(F.max("cap")).first()[0]
    free = listed.where(F.col("cap") >= UNCAPPED)
    if largest is None:
        return free.drop("cap")
    capped = listed.where(F.col("cap") < UNCAPPED)
    if largest <= max_rows:
        capped = _leading(capped, [source], largest, order)
    ranked = row_numbers(capped, [source], [F.col(c) for c in order], "__rn", max_rows)
    return ranked.where(F.col("__rn") <= F.col("cap")).select(*free.columns).unionByName(free).drop("cap")


def sample_per_class(
    df: DataFrame, label: str, k: int, ids: Sequence[str], seed: int = 42,
    position: Column | None = None,
) -> DataFrame:
    """``min(k, n)`` rows of every class, uniformly and repeatably.

    The ``k`` lowest seeded hash positions are a uniform sample without
    replacement, whatever the partitioning. Rows are compared with their
    class's cut, so the table itself is not shuffled.
    """
    placed = _placed(df, position, ids, seed)
    cuts = hash_cuts(placed, [label], _POSITION, ids, {"__cut": lambda n: F.lit(k)})
    kept = _attach(placed, bounded(cuts), [label]).where(
        F.struct(_POSITION, *ids) <= F.col("__cut")
    )
    return kept.select(*df.columns)


def slice_rows(
    df: DataFrame, skip: int, take: int, order: Sequence[str] = ("seq",),
    keys: Sequence[str] = (), max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Skip the first rows in order, then take some; per key when keys are given.

    The rows at both cuts are found by counting, and every row is compared
    with them where it is: the table itself is neither sorted nor shuffled.
    """
    return rows_between(
        df, keys, order, lambda n: F.least(F.lit(skip), n), lambda n: F.lit(skip + take), max_rows
    )


def stratified_split(
    df: DataFrame, label: str, parts: Mapping[str, float], ids: Sequence[str], seed: int = 42,
    position: Column | None = None, into: str = "part",
) -> DataFrame:
    """Assign every row to a part so that each class is split in proportion.

    Sizes are cumulative shares of the class, rounded to whole rows. Rows are
    compared with their class's cuts, so the table itself is not shuffled.
    """
    placed = _placed(df, position, ids, seed)
    names, ranks, upto = list(parts), {}, 0.0
    for name in names[:-1]:
        upto += parts[name]
        ranks[f"__cut_{name}"] = lambda n, share=upto: F.round(n * F.lit(share))
    cuts = hash_cuts(placed, [label], _POSITION, ids, ranks)
    cut = _attach(placed, bounded(cuts), [label], "left")
    here = F.struct(_POSITION, *ids)
    choice = F.when(here <= F.col(f"__cut_{names[0]}"), names[0])
    for name in names[1:-1]:
        choice = choice.when(here <= F.col(f"__cut_{name}"), name)
    return cut.withColumn(into, choice.otherwise(names[-1])).select(*df.columns, into)


def ordered_split(
    df: DataFrame, fraction: float = 0.8, order: Sequence[str] = ("seq",), into: str = "part",
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The first fraction of the rows by position is ``train``, the rest ``val``.

    Only the order columns are read to find the last training row; all rows
    are then compared with it.
    """
    cuts = value_cuts(df, [], order, {"train": lambda n: F.floor(n * F.lit(fraction))}, max_rows)
    cut = bounded(cuts.select(F.col("cut").alias("__cut"), F.lit(True).alias("__k")))
    # One row, or none when the share is less than a row.
    marked = df.withColumn("__k", F.lit(True)).join(cut, "__k", "left")
    return marked.withColumn(
        into, F.when(F.struct(*order) <= F.col("__cut"), "train").otherwise("val")
    ).select(*df.columns, into)


def _ranked_groups(
    df: DataFrame, group: str, label: str, seed: int, position: Column | None
) -> DataFrame:
    """One row per group: dominant class, rank among that class's groups, their number."""
    dominant = dominant_label(df, [group], label, into="__dominant")
    return hash_rank(
        _placed(dominant, position, [group], seed), ["__dominant"], _POSITION, [group],
        "__rank", total="__groups",
    )


def group_split(
    df: DataFrame, group: str, label: str, fraction: float = 0.2, seed: int = 42,
    position: Column | None = None, into: str = "part",
) -> DataFrame:
    """Hold out whole groups: per dominant class ``max(1, floor(f * groups))``.

    A class with a single group puts that group on the validation side.
    """
    groups = _ranked_groups(df, group, label, seed, position)
    held = F.greatest(F.lit(1), F.floor(F.col("__groups") * fraction))
    sides = groups.select(
        group, F.when(F.col("__rank") <= held, "val").otherwise("train").alias(into)
    )
    return df.join(bounded(sides), group)


def group_folds(
    df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42,
    position: Column | None = None, into: str = "fold",
) -> DataFrame:
    """Fold number per row; a group stays in one fold, classes are dealt in turn."""
    groups = _ranked_groups(df, group, label, seed, position)
    folds = groups.select(group, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int").alias(into))
    return df.join(bounded(folds), group)


def window_quota(
    windows: DataFrame, group: str, label: str, cap: int, order: Sequence[str], seed: int = 42,
    position: Column | None = None, max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Balance windows: at most ``cap`` per dominant class, taken group by group.

    Groups are visited in hash order and charge all their windows to their
    dominant class; the group that reaches the cap is cut short.
    """
    sizes = windows.groupBy(group).agg(F.count(F.lit(1)).alias("__w"))
    dominant = dominant_label(windows, [group], label, into="__dominant").join(sizes, group)
    spent = hash_running_total(
        _placed(dominant, position, [group], seed), ["__dominant"], _POSITION, [group],
        "__w", "__upto",
    )
    take = F.least(F.col("__w"), F.lit(cap) - (F.col("__upto") - F.col("__w")))
    allowed = spent.select(group, take.alias("__take")).where(F.col("__take") > 0)
    open_groups = windows.join(bounded(allowed), group)
    if cap <= max_rows:
        open_groups = _leading(open_groups, [group], cap, order)
    ranked = row_numbers(open_groups, [group], [F.col(c) for c in order], "__rn", max_rows)
    return ranked.where(F.col("__rn") <= F.col("__take")).select(*windows.columns)


def union_classes(parts: Mapping[int, DataFrame], into: str = "class_id") -> DataFrame:
    """Union of per-class tables with the class id attached."""
    tagged = [df.withColumn(into, F.lit(i)) for i, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_sources(
    parts: Mapping[str, tuple[DataFrame, int | None]], ids: Sequence[str], seed: int = 42,
    into: str = "source_name", position: Column | None = None,
) -> DataFrame:
    """Union of target domains, each sampled down to its own cap (None = all)."""
    kept = []
    for name, (df, cap) in parts.items():
        tagged = df.withColumn(into, F.lit(name))
        kept.append(tagged if cap is None else sample_per_class(tagged, into, cap, ids, seed, position=position))
    return reduce(DataFrame.unionByName, kept)


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` largest rows, descending; one bounded heap per task."""
    return df.orderBy(F.col(by).desc(), *ties).limit(k)
