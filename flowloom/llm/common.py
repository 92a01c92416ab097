"""Registry, table access, and helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import configure, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The characters that part words: space, tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL check, if it has one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends fewer rows to Python at once than usual: texts can be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in the lineage that every executor sees."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A number per row, where ids may repeat or be missing.
KEY = "flowloom row"
#: Bits of the number that count rows within a file, and files up to which their table is broadcast.
ROW_BITS, MOST_FILES = 36, 1_000_000
PLACE = ("flowloom file", "flowloom position", "flowloom ordinal")


def keyed(df: DataFrame, name: str, scanned: bool = False) -> DataFrame:
    """``df`` with a number of its own for each row in ``KEY``.

    ``scanned`` says that ``df`` is read from files and nothing multiplies its rows: the number is then
    the row's place, by file and position, and nothing is written. Otherwise ``df`` is stored first.
    """
    placed = None
    if scanned:
        try:
            placed = df.withColumns({PLACE[0]: F.col("_metadata.file_path"), PLACE[1]: F.col("_metadata.row_index")})
        except AnalysisException:
            # not one scan, but a union of several, say: its rows have no place
            placed = None
    if placed is not None:
        # one row per file, so that one task numbers them
        files = placed.select(PLACE[0]).distinct().coalesce(1).withColumn(PLACE[2], F.monotonically_increasing_id())
        numbers = sized(stored(files, f"{name}-files"), MOST_FILES)
        number = F.shiftleft(F.col(f"`{PLACE[2]}`"), ROW_BITS) + F.col(f"`{PLACE[1]}`")
        rows = placed.join(numbers, PLACE[0]).withColumn(KEY, number)
        return rows.select(*[f"`{c}`" for c in df.columns], f"`{KEY}`")
    return stored(df.withColumn(KEY, F.monotonically_increasing_id()), name)


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for broadcast only if its rows have been counted and are ``most`` or fewer.

    Callers pass stored or small frames of narrow rows. Beyond the bound, Spark joins by a shuffle.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, kind: str, add: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array of ``kind`` under ``add``, which is associative, as an array.

    An array that grows step by step is copied at each step, so totals run in blocks of about the root
    of its size, then over the blocks.
    """

    def scan(block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            return F.concat(acc, F.array(F.when(last.isNull(), x).otherwise(add(last, x))))

        return F.aggregate(block, F.array().cast(f"array<{kind}>"), step)

    def joined(blocks: Column, before: Column) -> Column:
        def moved(block: Column, i: Column) -> Column:
            return F.when(i == 0, block).otherwise(F.transform(block, lambda x: add(F.get(before, i - 1), x)))

        return F.flatten(F.transform(blocks, moved))

    def totals(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(v), step), lambda i: scan(F.slice(v, i, step)))
        return let(blocks, lambda b: let(scan(F.transform(b, lambda x: F.get(x, F.size(x) - 1))), lambda before: joined(b, before)))

    return let(values, lambda v: F.when(F.size(v) > 0, totals(v)).otherwise(F.array().cast(f"array<{kind}>")))


def words(text: Column) -> Column:
    """The words of a text as an array; null and wordless texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame, *taken: str) -> DataFrame:
    """All columns as one struct ``row``, and copies of some beside it: no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`").alias(c) for c in taken])
