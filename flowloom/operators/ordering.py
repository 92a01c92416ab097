"""Ranks and running totals that hold when one key owns most of the rows.

A plain window sorts each key in one task. That is the cheapest plan while
every key is small, so it is used for those keys; keys above ``max_rows`` take
another road with the same result:

* *value order* (:func:`row_numbers`, :func:`running_totals`): the rows of the
  heavy keys are range-partitioned by key and order, which splits a key over
  many tasks; the pieces are checkpointed so that both later passes see the
  same pieces, and every piece gets the totals of the pieces before it;
* *hash order* (:func:`hash_rank`, :func:`hash_running_total`): positions are
  uniform in ``[0, 2**32)``, so their leading bits cut any key evenly and no
  checkpoint is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_dir

#: Rows up to which a lookup table is broadcast.
BROADCAST_ROWS = 500_000
#: Rows of one key that a single task may sort.
MAX_GROUP_ROWS = 1_000_000
#: Sampled rows that a key at the limit is expected to show.
SAMPLED_PER_KEY = 1000
#: Hash positions lie in [0, POSITIONS).
POSITIONS = 1 << 32
#: Slices a key is cut into in hash order.
HASH_SLICES = 1024


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how="inner") -> DataFrame:
    """Join on null-safe keys, keeping one copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"__o_key_{k}" for k in keys})
    match = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__o_key_{k}")) for k in keys],
        F.lit(True),
    )
    joined = left.join(renamed, match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__o_key_{k}" for k in keys])


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a derived lookup table; broadcast it if its size allows.

    Spark cannot size an aggregate before it runs and would shuffle the large
    side on the lookup key, which is often a class with most of the rows.
    Beyond the limit the join is left to the planner.
    """
    shared_dir(df.sparkSession)
    kept = df.checkpoint()
    return F.broadcast(kept) if kept.count() <= limit else kept


def split_heavy(
    df: DataFrame,
    keys: Sequence[str],
    max_rows: int = MAX_GROUP_ROWS,
    among: Column | None = None,
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of small keys and rows of heavy keys; either side may be None.

    Both roads give the same result, so the split may rest on an estimate: the
    keys of a fixed sample, sized so that a key of ``max_rows`` rows shows up
    about ``SAMPLED_PER_KEY`` times. Small limits count every row. Only the
    key columns are read. At most a few times ``rows / max_rows`` keys are
    heavy, which bounds what is broadcast. ``among`` limits the count to rows
    whose key can repeat.
    """
    keys = list(keys)
    if not keys:
        return (df, None) if df.count() <= max_rows else (None, df)
    shared_dir(df.sparkSession)
    seen, limit = (df if among is None else df.where(among)).select(*keys), max_rows
    if max_rows > SAMPLED_PER_KEY:
        share = SAMPLED_PER_KEY / max_rows
        # Four fifths of the expectation, more than six deviations below it.
        seen, limit = seen.sample(share, seed=42), int(0.8 * SAMPLED_PER_KEY)
    heavy = (
        seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__o_n"))
        .where(F.col("__o_n") > limit).drop("__o_n").checkpoint()
    )
    found = heavy.count()
    if found == 0:
        return df, None
    if found <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    return (
        _attach(df, heavy, keys, "left_anti"),
        _attach(df, heavy, keys, "left_semi"),
    )


def _pieces(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Sorted range pieces: ``__o_piece`` in order, ``__o_pos`` rising inside a piece.

    The checkpoint fixes the piece boundaries: a range partitioner samples, so
    planning it twice could place a row differently.
    """
    shared_dir(df.sparkSession)
    sort = [F.col(k) for k in keys] + list(order)
    return (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("__o_piece", F.spark_partition_id())
        .withColumn("__o_pos", F.monotonically_increasing_id())
        .checkpoint()
    )


def _before(pieces: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Per (key, piece): the key's totals in earlier pieces and overall.

    One row per key and piece: the partition count plus the number of keys,
    and only heavy keys come here, so the result is small enough to broadcast.
    """
    per_piece = pieces.groupBy(*keys, "__o_piece").agg(
        *[F.sum(col).alias(f"__o_{name}") for name, col in totals.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("__o_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return per_piece.select(
        *keys, "__o_piece",
        *[F.coalesce(F.sum(f"__o_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}_before") for n in totals],
        *[F.sum(f"__o_{n}").over(whole).alias(f"__o_{n}_all") for n in totals],
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add inclusive running sums ``name`` and group sums ``name_all``.

    ``order`` must be a total order within a key.
    """
    keys, order = list(keys), list(order)
    light, heavy = split_heavy(df, keys, max_rows)
    done = []
    if light is not None:
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        done.append(light.withColumns({
            **{n: F.sum(c).over(so_far) for n, c in totals.items()},
            **{f"{n}_all": F.sum(c).over(whole) for n, c in totals.items()},
        }))
    if heavy is not None:
        pieces = _pieces(heavy, keys, order)
        within = (
            Window.partitionBy(*keys, "__o_piece").orderBy("__o_pos")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        summed = pieces.withColumns({n: F.sum(c).over(within) for n, c in totals.items()})
        placed = _attach(
            summed, F.broadcast(_before(pieces, keys, totals)), [*keys, "__o_piece"]
        )
        done.append(placed.withColumns({
            **{n: F.col(n) + F.col(f"__o_{n}_before") for n in totals},
            **{f"{n}_all": F.col(f"__o_{n}_all") for n in totals},
        }).select(*df.columns, *totals, *[f"{n}_all" for n in totals]))
    return reduce(DataFrame.unionByName, done)


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rn",
    max_rows: int = MAX_GROUP_ROWS,
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based rank within the key; optionally the key's row count.

    Range pieces are sorted, so the rank of a row in its piece is its distance
    from the first row of the key there: the heavy road needs no second sort.
    """
    keys, order = list(keys), list(order)
    light, heavy = split_heavy(df, keys, max_rows)
    wanted = [*df.columns, name] + ([total] if total else [])
    done = []
    if light is not None:
        ranked = light.withColumn(
            name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
        )
        if total:
            ranked = ranked.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        done.append(ranked.select(*wanted))
    if heavy is not None:
        pieces = _pieces(heavy, keys, order)
        first = pieces.groupBy(*keys, "__o_piece").agg(F.min("__o_pos").alias("__o_first"))
        counts = _before(pieces, keys, {"n": F.lit(1).cast("long")})
        placed = _attach(
            pieces,
            F.broadcast(_attach(counts, first, [*keys, "__o_piece"])),
            [*keys, "__o_piece"],
        ).withColumn(name, F.col("__o_pos") - F.col("__o_first") + F.col("__o_n_before") + 1)
        if total:
            placed = placed.withColumn(total, F.col("__o_n_all"))
        done.append(placed.select(*wanted))
    return reduce(DataFrame.unionByName, done)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    mark: str,
    left: str = "left",
    right: str = "right",
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add the closest non-null ``mark`` at or before and at or after each row.

    An as-of lookup without pairs: marks travel along the sorted key in both
    directions. ``order`` must be a total order within a key.
    """
    keys, order = list(keys), list(order)
    light, heavy = split_heavy(df, keys, max_rows)
    seen = (Window.unboundedPreceding, 0)

    def both(rows: DataFrame, part: list[str], by: list[str]) -> DataFrame:
        up = Window.partitionBy(*part).orderBy(*by).rowsBetween(*seen)
        down = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in by]).rowsBetween(*seen)
        return rows.withColumns({
            left: F.last(mark, ignorenulls=True).over(up),
            right: F.last(mark, ignorenulls=True).over(down),
        })

    done = []
    if light is not None:
        done.append(both(light, keys, order))
    if heavy is not None:
        pieces = _pieces(heavy, keys, [F.col(c) for c in order])
        marked = F.when(F.col(mark).isNotNull(), F.col("__o_pos"))
        ends = pieces.groupBy(*keys, "__o_piece").agg(
            F.min_by(mark, marked).alias("__o_low"), F.max_by(mark, marked).alias("__o_high"),
        )
        before = Window.partitionBy(*keys).orderBy("__o_piece").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*keys).orderBy(F.col("__o_piece").desc()).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carried = ends.select(
            *keys, "__o_piece",
            F.last("__o_high", ignorenulls=True).over(before).alias("__o_carry_left"),
            F.last("__o_low", ignorenulls=True).over(after).alias("__o_carry_right"),
        )
        placed = _attach(
            both(pieces, [*keys, "__o_piece"], ["__o_pos"]), F.broadcast(carried), [*keys, "__o_piece"]
        )
        done.append(placed.withColumns({
            left: F.coalesce(left, "__o_carry_left"), right: F.coalesce(right, "__o_carry_right"),
        }).select(*df.columns, left, right))
    return reduce(DataFrame.unionByName, done)


def with_halo(df: DataFrame, rank: str, chunk_rows: int, back: int) -> DataFrame:
    """Cut ranked rows into chunks that start with the ``back`` rows before them.

    Adds ``__chunk`` and ``__halo``. A frame of up to ``back`` preceding rows
    computed per chunk is right for every row with ``__halo`` false. Only the
    last ``back`` rows of a full chunk are repeated.
    """
    if back >= chunk_rows:
        raise ValueError("a chunk must be longer than its halo")
    chunk = F.floor((F.col(rank) - 1) / F.lit(chunk_rows)).cast("long")
    place = F.pmod(F.col(rank) - 1, F.lit(chunk_rows))
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("halo"))
    ahead = F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("halo"))
    copies = F.when(place >= chunk_rows - back, F.array(own, ahead)).otherwise(F.array(own))
    return (
        df.withColumn("__copy", F.explode(copies))
        .withColumn("__chunk", F.col("__copy.chunk"))
        .withColumn("__halo", F.col("__copy.halo"))
        .drop("__copy")
    )


# Hash order -----------------------------------------------------------------


def hash_position(*cols: str, seed: int = 42) -> Column:
    """Pseudo-random position in [0, 2**32), fixed by the values and the seed."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(seed)), F.lit(POSITIONS))


def mixed_position(code: Column) -> Column:
    """Multiplicative position of a bigint code; plain arithmetic, so portable."""
    return F.pmod(
        F.pmod(code, F.lit(1 << 31)) * F.lit(2_654_435_761).cast("long"), F.lit(POSITIONS)
    )


def _slice_of(position: str, slices: int) -> Column:
    return F.floor(F.col(position) / F.lit(POSITIONS // slices)).cast("int")


def _slices(df: DataFrame, keys, slices: int, position: str, weight: Column) -> DataFrame:
    """Per (key, slice): weight before the slice and weight of the key."""
    per = (
        df.withColumn("__o_slice", _slice_of(position, slices))
        .groupBy(*keys, "__o_slice").agg(F.sum(weight).alias("__o_w"))
    )
    earlier = Window.partitionBy(*keys).orderBy("__o_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        *keys, "__o_slice",
        F.coalesce(F.sum("__o_w").over(earlier), F.lit(0).cast("long")).alias("__o_before"),
        F.sum("__o_w").over(Window.partitionBy(*keys)).alias("__o_all"), "__o_w",
    )


def hash_cuts(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    ties: Sequence[str],
    ranks: Mapping[str, Callable[[Column], Column]],
    slices: int = HASH_SLICES,
) -> DataFrame:
    """Per key, the (position, ties) of the rows at the given hash ranks.

    ``ranks`` maps a name to a rank computed from the key's row count; a rank
    beyond the key gives its last row, rank 0 gives null. Comparing rows with
    the cut then splits a table without sorting or shuffling it: only the
    slices that hold a cut are ranked.
    """
    keys = list(keys)
    width = _slices(df, keys, slices, position, F.lit(1).cast("long"))
    upto = F.col("__o_before") + F.col("__o_w")
    sought = {
        n: F.least(rank(F.col("__o_all")), F.col("__o_all")).cast("long")
        for n, rank in ranks.items()
    }
    wanted = F.filter(
        F.array(*sought.values()),
        lambda r: (r > F.col("__o_before")) & (r <= upto),
    )
    holding = width.withColumn("__o_ranks", wanted).where(F.size("__o_ranks") > 0)
    narrow = df.select(*keys, position, *[t for t in ties if t not in keys]).withColumn(
        "__o_slice", _slice_of(position, slices)
    )
    near = _attach(narrow, bounded(holding), [*keys, "__o_slice"])
    within = Window.partitionBy(*keys, "__o_slice").orderBy(position, *ties)
    ranked = near.withColumn("__o_rank", F.row_number().over(within) + F.col("__o_before"))
    place = F.struct(position, *ties)
    return ranked.where(F.array_contains("__o_ranks", F.col("__o_rank"))).groupBy(*keys).agg(*[
        F.max(F.when(F.col("__o_rank") == rank, place)).alias(n) for n, rank in sought.items()
    ])


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    ties: Sequence[str],
    name: str = "rn",
    total: str | None = None,
    slices: int = HASH_SLICES,
) -> DataFrame:
    """1-based rank by ``position`` within the key, ties broken by ``ties``."""
    keys = list(keys)
    offsets = bounded(_slices(df, keys, slices, position, F.lit(1).cast("long")))
    placed = _attach(
        df.withColumn("__o_slice", _slice_of(position, slices)), offsets, [*keys, "__o_slice"]
    )
    within = Window.partitionBy(*keys, "__o_slice").orderBy(position, *ties)
    ranked = placed.withColumn(name, F.row_number().over(within) + F.col("__o_before"))
    if total:
        ranked = ranked.withColumn(total, F.col("__o_all"))
    return ranked.select(*df.columns, name, *([total] if total else []))


def hash_running_total(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    ties: Sequence[str],
    value: str,
    name: str,
    slices: int = HASH_SLICES,
) -> DataFrame:
    """Inclusive running sum of ``value`` in hash order within the key."""
    keys = list(keys)
    offsets = bounded(_slices(df, keys, slices, position, F.col(value)))
    placed = _attach(
        df.withColumn("__o_slice", _slice_of(position, slices)), offsets, [*keys, "__o_slice"]
    )
    within = (
        Window.partitionBy(*keys, "__o_slice").orderBy(position, *ties)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return placed.withColumn(
        name, F.sum(value).over(within) + F.col("__o_before")
    ).select(*df.columns, name)
