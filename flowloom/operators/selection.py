"""Rows at given ranks in value order, found by histograms instead of a sort.

To cut a table after its first n rows, only the row at the cut has to be known: all others can be compared
with it where they are. :func:`value_cuts` narrows down to that row. The order columns are read as numbers
that never decrease along the order; a pass over the narrow table counts them in equal bins between their
extremes, keeps the bin that holds the rank, and the next pass does the same inside of it, until at most
``max_rows`` rows are left to be sorted. No task sorts more, whatever the size of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .ordering import MAX_GROUP_ROWS, _attach, bounded, row_numbers

#: Bins of a pass. Each is a row per key and rank.
BINS = 4096
#: Bytes of a text that make a number, exactly.
CHUNK = 6
HUGE = 1.7e308


def _codes(col: Column, kind: T.DataType, longest: Mapping[str, int], path: str) -> Iterator[Column | None]:
    """Numbers in the order of a value, missing ones first; equal only where values are, or None follows."""
    if isinstance(kind, T.StructType):
        for f in kind:
            yield from _codes(col[f.name], f.dataType, longest, f"{path}.{f.name}")
        return
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = F.hex(col.cast("binary"))
        for at in range(0, longest[path], CHUNK):
            piece = F.rpad(F.substring(raw, 2 * at + 1, 2 * CHUNK), 2 * CHUNK, "0")
            yield F.coalesce(F.conv(piece, 16, 10).cast("double"), F.lit(-1.0))
        yield F.coalesce(F.octet_length(col).cast("double"), F.lit(-1.0))
        return
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        endless = F.abs(col) == float("inf")
        yield F.when(F.isnan(col), 2.0).when(endless, F.signum(col)).when(col.isNotNull(), 0.0).otherwise(-2.0)
        yield F.when(endless | F.isnan(col) | col.isNull(), 0.0).otherwise(col.cast("double"))
        return
    if isinstance(kind, T.TimestampNTZType):
        col, kind = col.cast("timestamp"), T.TimestampType()
    if isinstance(kind, T.TimestampType):
        col = F.unix_micros(col)
    elif isinstance(kind, T.DateType):
        col = F.unix_date(col)
    elif isinstance(kind, T.BooleanType):
        col = col.cast("int")
    if isinstance(kind, (T.DecimalType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        yield F.coalesce(col.cast("double"), F.lit(-HUGE))
        yield None  # neighbours may share a double
        return
    # Halves of a long are exact as doubles.
    yield F.coalesce(F.shiftright(col.cast("long"), 32).cast("double"), F.lit(-HUGE))
    yield F.coalesce(col.cast("long").bitwiseAND(F.lit((1 << 32) - 1)).cast("double"), F.lit(0.0))


def _texts(col: Column, kind: T.DataType, path: str) -> dict[str, Column]:
    if isinstance(kind, T.StructType):
        return {k: v for f in kind for k, v in _texts(col[f.name], f.dataType, f"{path}.{f.name}").items()}
    return {path: F.octet_length(col)} if isinstance(kind, (T.StringType, T.BinaryType)) else {}


def order_codes(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Numbers whose order, one after the other, never contradicts the order of the columns.

    They end early at a type whose values have no exact number; what ties there is left to a sort.
    """
    kinds = {c: df.schema[c].dataType for c in order}
    texts = {k: v for c in order for k, v in _texts(F.col(c), kinds[c], c).items()}
    longest = {}
    if texts:
        row = df.agg(*[F.max(v).alias(f"t{i}") for i, v in enumerate(texts.values())]).first()
        longest = {k: row[i] or 0 for i, k in enumerate(texts)}
    every = (x for c in order for x in _codes(F.col(c), kinds[c], longest, c))
    return list(takewhile(lambda x: x is not None, every))


def value_cuts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    ranks: Mapping[str, Callable[[Column], Column]], max_rows: int = MAX_GROUP_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """Per key and rank ``name``: ``cut``, the order columns of the row there, ``ties`` and ``taken``.

    ``ranks`` maps a name to a rank computed from the key's row count; ranks
    below 1 give no row, those beyond the key its last. ``ties`` counts the
    rows that equal the cut in all order columns, ``taken`` those of them up
    to the rank; both are 1 where the order is total.
    """
    shared_dir(df.sparkSession)
    keys, order = list(keys), list(order)
    codes = order_codes(df, order)
    n_codes = len(codes)
    narrow = df.select(*dict.fromkeys([*keys, *order])).withColumn("__x", F.array(*codes))

    def extremes() -> list[Column]:
        return [
            F.array(*[F.min(F.get("__x", F.lit(i))) for i in range(n_codes)]).alias("__lo"),
            F.array(*[F.max(F.get("__x", F.lit(i))) for i in range(n_codes)]).alias("__hi"),
        ]

    whole = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *extremes())
    sought = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.least(rank(F.col("__n")), F.col("__n")).cast("long").alias("rank"))
        for n, rank in ranks.items()
    ]))
    state = whole.withColumn("__s", sought).select(
        *keys, "__n", "__lo", "__hi", F.col("__s.name").alias("name"), F.col("__s.rank").alias("rank"),
    ).where(F.col("rank") >= 1).checkpoint()
    group = [*keys, "name"]

    def inside(ranges: DataFrame) -> DataFrame:
        """Rows within each range, with the range's columns."""
        fits = reduce(lambda a, b: a & b, [
            F.get("__x", F.lit(i)).between(F.get("__lo", F.lit(i)), F.get("__hi", F.lit(i)))
            for i in range(n_codes)
        ])
        return _attach(narrow, bounded(ranges), keys).where(fits)

    done = []
    open_ = (F.col("__n") > max_rows) & (F.col("__lo") != F.col("__hi"))
    while True:
        done.append(state.where(~open_))
        state = state.where(open_)
        if state.isEmpty():
            break
        # The first number that still varies is the one to cut by.
        spot = F.array_position(F.zip_with("__lo", "__hi", lambda a, b: a < b), True).cast("int") - 1
        ranges = state.withColumn("__at", spot).withColumns({
            "__from": F.get("__lo", F.col("__at")), "__to": F.get("__hi", F.col("__at")),
        })
        # Halves first: the width of a range of doubles may be beyond them.
        share = (F.get("__x", F.col("__at")) / 2 - F.col("__from") / 2) / (F.col("__to") / 2 - F.col("__from") / 2)
        counted = inside(ranges).withColumn(
            "__bin", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
        ).groupBy(*group, "rank", "__bin").agg(F.count(F.lit(1)).alias("__n"), *extremes())
        upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__bin"))
        state = counted.withColumn("__upto", upto).where(
            (F.col("rank") <= F.col("__upto")) & (F.col("rank") > F.col("__upto") - F.col("__n"))
        ).withColumn("rank", F.col("rank") - (F.col("__upto") - F.col("__n"))).select(
            *keys, "__n", "__lo", "__hi", "name", "rank"
        ).checkpoint()
    final = reduce(DataFrame.unionByName, done)
    left = inside(final).select(*group, "rank", *order)
    place = F.struct(*order)
    found = row_numbers(left, group, [F.col(c) for c in order], "__rn", max_rows).where(
        F.col("__rn") == F.col("rank")
    ).select(*group, place.alias("cut")).checkpoint()
    near = _attach(left, bounded(found), group)
    return near.groupBy(*group, "rank").agg(
        F.first("cut").alias("cut"), F.count_if(place == F.col("cut")).alias("ties"),
        F.count_if(place < F.col("cut")).alias("__below"),
    ).select(*group, "cut", "ties", (F.col("rank") - F.col("__below")).alias("taken"))


def rows_between(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    after: Callable[[Column], Column], upto: Callable[[Column], Column],
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rows of each key with ``after < rank <= upto`` in order; both from the key's row count.

    Rows are compared with the cuts of their key and are not shuffled. Where
    equal rows lie on both sides of a cut, those few are ranked, so the sizes
    are exact although it is open which of them are kept.
    """
    shared_dir(df.sparkSession)
    keys, order = list(keys), list(order)
    cuts = value_cuts(df, keys, order, {"after": after, "upto": upto}, max_rows)
    side = {
        f"__{name}_{c}": F.max(F.when(F.col("name") == name, F.col(c)))
        for name in ("after", "upto") for c in ("cut", "ties", "taken")
    }
    # Without keys there is one row at most, none for an empty table.
    pairs = cuts.groupBy(*keys).agg(*[c.alias(n) for n, c in side.items()]).checkpoint()
    split = pairs.where(
        (F.col("__after_taken") < F.col("__after_ties")) | (F.col("__upto_taken") < F.col("__upto_ties"))
    )
    here = F.struct(*order)
    placed = _attach(df, bounded(pairs), keys)
    within = placed.where(
        F.col("__upto_cut").isNotNull() & (here <= F.col("__upto_cut"))
        & (F.col("__after_cut").isNull() | (here >= F.col("__after_cut")))
    )
    past = F.col("__after_cut").isNull() | (here > F.col("__after_cut"))
    if split.isEmpty():
        return within.where(past).select(*df.columns)
    at_cut = (here == F.col("__upto_cut")) | F.coalesce(here == F.col("__after_cut"), F.lit(False))
    ranked = row_numbers(
        within.where(at_cut).withColumn("__here", here), [*keys, "__here"], [F.col(c) for c in order], "__tie", max_rows
    )
    kept = ranked.where(
        (past | (F.col("__tie") > F.col("__after_taken")))
        & ((here < F.col("__upto_cut")) | (F.col("__tie") <= F.col("__upto_taken")))
    )
    return within.where(~at_cut).select(*df.columns).unionByName(kept.select(*df.columns))
