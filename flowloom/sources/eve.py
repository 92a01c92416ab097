"""Event scans: JSON lines to the typed event table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.timefmt import parse_ts
from ..operators.sampling import UNCAPPED
from ..schema import EVE, EVE_TEXT

#: Substring that marks a flow line written without spaces.
FLOW_LINE = '"event_type":"flow"'


def _typed(col: Column, kind: T.DataType) -> Column:
    """Text scan value -> typed value; unreadable scalars become null."""
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[
            _typed(col[f.name], f.dataType).alias(f.name) for f in kind
        ]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _typed(x, kind.elementType))
    if isinstance(kind, T.TimestampType):
        return parse_ts(col)
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return col
    if isinstance(kind, (T.IntegerType, T.LongType)):
        # "80", 80 and 80.0 all read as 80.
        return F.coalesce(col.try_cast(kind), F.floor(col.try_cast("double")).try_cast(kind))
    return col.try_cast(kind)


def _hex_text(flags: Column) -> Column:
    """Flags as hexadecimal text, from a JSON text (hexadecimal) or number (decimal)."""
    number = F.try_variant_get(flags, "$", "double")
    return F.when(F.schema_of_variant(flags) == "STRING", F.try_variant_get(flags, "$", "string")).when(
        number.between(0, 0xFFFFFFFF), F.lower(F.hex(F.floor(number)))
    )


def type_events(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Text-typed records -> :data:`flowloom.schema.EVE` plus ``extra`` columns."""
    if isinstance(raw.schema["tcp"].dataType["tcp_flags_tc"].dataType, T.VariantType):
        raw = raw.withColumn("tcp", F.col("tcp").withField("tcp_flags_tc", _hex_text(F.col("tcp.tcp_flags_tc"))))
    return raw.select(
        *[_typed(F.col(f.name), f.dataType).alias(f.name) for f in EVE], *extra
    )


def line_position() -> Column:
    """File order of a line: file, block, line within the block.

    The id rises with the lines of a block, so the triple orders all lines as
    they stand in their files without a shuffle.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_eve(
    spark: SparkSession, path: str | Sequence[str], keep_corrupt: bool = False,
    recursive: bool = False, name_glob: str | None = None,
) -> DataFrame:
    """Typed event table with ``seq`` (line order) and ``file``.

    Blank lines vanish; malformed lines are dropped, or kept with
    ``is_corrupt`` true so that a run can count what it skipped.
    """
    reader = spark.read.schema(EVE_TEXT).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    raw = reader.json(path if isinstance(path, str) else list(path)).withColumns({
        "seq": line_position(),
        "file": F.col("_metadata.file_path"),
        # Nothing of a malformed line is kept, so its type is missing as well.
        "is_corrupt": F.col("_corrupt_record").isNotNull() & F.col("event_type").isNull(),
    })
    typed = type_events(raw, ["seq", "file", "is_corrupt"])
    return typed if keep_corrupt else typed.where(~F.col("is_corrupt")).drop("is_corrupt")


def read_flow_lines(spark: SparkSession, path: str | Sequence[str],
                    marker: str | None = FLOW_LINE) -> DataFrame:
    """Scan as text and parse only the lines that contain ``marker``.

    The test is on the raw bytes, so it misses lines written with spaces;
    ``None`` parses every line. Non-flow rows are dropped either way.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path)).withColumns({
        "seq": line_position(), "file": F.col("_metadata.file_path"),
    })
    if marker:
        lines = lines.where(F.col("value").contains(marker))
    layout = T.StructType([f for f in EVE_TEXT if f.name != "_corrupt_record"])
    parsed = lines.select(F.from_json("value", layout).alias("e"), "seq", "file")
    return type_events(parsed.select("e.*", "seq", "file"), ["seq", "file"]).where(
        F.col("event_type") == "flow"
    )


def live_order() -> Column:
    """Order among events of one instant: records before the flow that takes them, then by content.

    Every field counts, so only equal events tie.
    """
    content = F.xxhash64(*[F.to_json(f.name) if isinstance(f.dataType, T.StructType) else F.col(f.name) for f in EVE])
    after = F.when(F.col("event_type") == "flow", 1).otherwise(0).cast("long")
    return F.shiftleft(after, 62).bitwiseOR(F.shiftrightunsigned(content, 2))


def stream_eve(spark: SparkSession, path: str, max_files: int = 100,
               name_glob: str | None = None) -> DataFrame:
    """Live scan: a shipper drops finished segments into ``path``.

    A stream has no line numbers: ``seq`` orders events of one instant, see
    :func:`live_order`. Existing files count as the backlog.
    """
    reader = spark.readStream.schema(EVE_TEXT).option("maxFilesPerTrigger", max_files)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    raw = reader.json(path).withColumn("file", F.col("_metadata.file_path"))
    typed = type_events(raw.where(F.col("_corrupt_record").isNull() | F.col("event_type").isNotNull()), ["file"])
    return typed.withColumn("seq", live_order())


def route(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flows, protocol records, and everything else."""
    kind = F.coalesce(F.col("event_type"), F.lit(""))
    protocol = kind.isin("http", "tls", "dns")
    return (
        events.where(kind == "flow"),
        events.where(protocol),
        events.where((kind != "flow") & ~protocol),
    )


def class_of_file(col: Column | None = None, prefix: str = "eve_") -> Column:
    """Class from a file name ``eve_<Class>.json``; null when it does not fit."""
    name = F.col("file") if col is None else col
    return F.nullif(F.regexp_extract(name, prefix + r"([^/]+)\.json$", 1), F.lit(""))


def read_labeled_tree(spark: SparkSession, root: str) -> DataFrame:
    """All ``eve_<Class>.json`` files below a folder, with their class."""
    return read_eve(spark, root, recursive=True, name_glob="eve_*.json").withColumn(
        "label", class_of_file()
    )


def read_catalogue(spark: SparkSession, sources: dict[str, Sequence[str]],
                   caps: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of a class -> files catalogue, and the catalogue as a table.

    Pass both to :func:`flowloom.operators.sampling.first_n_by_source` to apply
    the per-source caps.
    """
    caps = caps or {}
    rows = [(p, c, caps.get(c, UNCAPPED)) for c, paths in sources.items() for p in paths]
    events = read_eve(spark, [p for p, _, _ in rows])
    listing = spark.createDataFrame(rows, "path string, class string, cap long")
    return (
        events.withColumn("file", plain_path(F.col("file"))),
        listing.select(plain_path(F.col("path")).alias("file"), "class", "cap"),
    )


def plain_path(col: Column) -> Column:
    """A path without scheme and percent escapes, comparable with a given one."""
    bare = F.regexp_replace(col, "^[A-Za-z0-9]+:/+", "/")
    return F.when(bare.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(
        F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare
    )).otherwise(bare)


def scenario_of(file: Column, root: str) -> Column:
    """The folder right below ``root`` on the way to the file."""
    base = re.escape(root.rstrip("/").rsplit("/", 1)[-1])
    return F.regexp_extract(plain_path(file), f"/{base}/([^/]+)/", 1)


def read_scenarios(spark: SparkSession, root: str, name_glob: str = "eve.json") -> DataFrame:
    """One scan over ``root/<scenario>/.../eve.json``, scenario from the path."""
    return read_eve(spark, root, recursive=True, name_glob=name_glob).withColumn(
        "scenario", scenario_of(F.col("file"), root)
    )
