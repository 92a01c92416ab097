"""Ground-truth scans: flow label tables, attack windows, capture notes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.coerce import digits_or_zero
from ..functions.labels import attack_family, protocol
from ..functions.timefmt import ARGUS_FORMATS, ISO, LABEL_CSV_FORMATS, micros, parse_ts
from ..schema import BINETFLOW
from .eve import line_position, scenario_of

# Accepted column names of label tables.
REQUIRED_COLUMNS = {
    "dest_port": ("Dst Port", "Destination Port", "dst_port"),
    "proto": ("Protocol", "proto"),
    "timestamp": ("Timestamp", "timestamp"),
    "label": ("Label", "label"),
}
OPTIONAL_COLUMNS = {
    "src_ip": ("Src IP", "Source IP", "src_ip"),
    "src_port": ("Src Port", "Source Port", "src_port"),
    "dest_ip": ("Dst IP", "Destination IP", "dst_ip"),
}
# Pattern that finds a malware family in a capture's notes.
FAMILY_PATTERN = r"(?i)(?:malware|family|botnet|name)[:\s]+([A-Za-z0-9_\-\.]+)"


def read_binetflow(spark: SparkSession, path: str | Sequence[str], tz: str | None = None,
                   precision: str | None = None) -> DataFrame:
    """Argus flow labels; short rows, comments, headers and bad times are dropped.

    Ports that are not plain digits become 0. ``tz`` is the zone of the
    capture's clock, e.g. ``"+02:00"``.
    """
    raw = (
        spark.read.schema(BINETFLOW).option("mode", "PERMISSIVE").option("comment", "#")
        .csv(path if isinstance(path, str) else list(path))
        .withColumns({"seq": line_position(), "file": F.col("_metadata.file_path")})
    )
    iso = F.col("StartTime").contains("T")
    at = F.when(iso, parse_ts(F.col("StartTime"), (ISO,), None, precision)).otherwise(
        parse_ts(F.col("StartTime"), ARGUS_FORMATS, tz, precision)
    )
    return raw.where(
        F.col("Label").isNotNull() & ~F.col("StartTime").contains("StartTime")
    ).select(
        at.alias("ts"), protocol(F.col("Proto")).alias("proto"),
        F.trim("SrcAddr").alias("src_ip"), digits_or_zero(F.col("Sport")).alias("src_port"),
        F.trim("DstAddr").alias("dest_ip"), digits_or_zero(F.col("Dport")).alias("dest_port"),
        F.trim("Label").alias("label"), "seq", "file",
    ).where(F.col("ts").isNotNull() & (micros(F.col("ts")) > 0))


def read_label_csv(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, bool]:
    """Label table under any of its column names, and whether all of it has the 5-tuple.

    Files may differ in their headers, in names and in order: those with the
    same header are read together, and each header is resolved on its own.
    Only the named columns are read. Rows with an unreadable port or time are
    skipped. Where only some files have endpoints, the rows of the others have
    nulls there, see :func:`flowloom.operators.labeling.mixed_label`. One pass
    over the files' first lines finds the headers; the driver sees one row per
    header.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    )
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    found = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("files").collect()
    if not found:
        raise ValueError("label table has no file with a line")
    tables = [_label_rows(spark, row["files"]) for row in found]
    some, full = (check(has for _, has in tables) for check in (any, all))
    kept = [rows if some else rows.drop(*OPTIONAL_COLUMNS) for rows, _ in tables]
    return reduce(DataFrame.unionByName, kept), full


def _label_rows(spark: SparkSession, path: Sequence[str]) -> tuple[DataFrame, bool]:
    """Rows of label files that share one header."""
    raw = spark.read.option("header", "true").csv(list(path))
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    present = set(raw.columns)

    def resolve(names: Sequence[str]) -> str | None:
        return next((n for n in names if n in present), None)

    found = {k: resolve(v) for k, v in REQUIRED_COLUMNS.items()}
    missing = [k for k, v in found.items() if v is None]
    if missing:
        raise KeyError(f"label table lacks {missing}; it has {sorted(present)}")
    optional = {k: resolve(v) for k, v in OPTIONAL_COLUMNS.items()}
    full = all(optional.values())

    def col(name: str):
        return F.col(f"`{name}`")

    ends = {k: F.trim(col(v)) if full else F.lit(None).cast("string") for k, v in optional.items()}
    out = {
        "dest_port": F.trim(col(found["dest_port"])).try_cast("int"),
        "proto": protocol(col(found["proto"]), upper=True),
        "ts": parse_ts(col(found["timestamp"]), LABEL_CSV_FORMATS),
        "label": attack_family(col(found["label"])),
        **ends, "src_port": ends["src_port"].try_cast("int"),
    }
    rows = raw.select(
        *[c.alias(n) for n, c in out.items()], line_position().alias("seq"),
        F.col("_metadata.file_path").alias("file"),
    )
    needed = ["dest_port", "ts"] + (["src_port"] if full else [])
    return rows.dropna(subset=needed), full


def read_attack_windows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Attack windows (start, end) and victim addresses (ip) of a labels.json."""
    raw = spark.read.schema(
        "attack_windows array<struct<start:string,end:string>>, victim_ips array<string>"
    ).option("multiLine", "true").json(path)
    windows = raw.select(F.explode("attack_windows").alias("w")).select(
        parse_ts(F.col("w.start")).alias("start"), parse_ts(F.col("w.end")).alias("end")
    )
    return windows, raw.select(F.explode("victim_ips").alias("ip"))


def read_families(spark: SparkSession, root: str, default: str = "Bot") -> DataFrame:
    """Malware family per scenario folder, from its notes.

    Notes are ``*.html``, ``*.txt`` and ``README*`` files, tried in that order;
    scenarios whose notes say nothing get the default.
    """
    notes = (
        spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{*.html,*.txt,README*}").text(root)
        .select(
            scenario_of(F.col("_metadata.file_path"), root).alias("scenario"),
            F.col("_metadata.file_name").alias("name"),
            F.nullif(F.regexp_extract("value", FAMILY_PATTERN, 1), F.lit("")).alias("family"),
        )
    )
    turn = (
        F.when(F.col("name").endswith(".html"), 0).when(F.col("name").endswith(".txt"), 1)
        .otherwise(2)
    )
    return notes.groupBy("scenario").agg(F.coalesce(
        F.min_by("family", F.when(F.col("family").isNotNull(), F.struct(turn, F.col("name")))),
        F.lit(default),
    ).alias("malware_family"))


def match_capture_dates(
    flows: DataFrame, labels: DataFrame, capture: str = "scenario", ts: str = "ts",
    order: Sequence[str] = ("seq",), label_file: str = "file",
) -> DataFrame:
    """Label rows per capture: files named after the capture day, else all files.

    The day is that of the capture's first flow. Label rows are repeated per
    capture that uses their file, keyed by the capture.
    """
    days = flows.groupBy(capture).agg(
        F.min_by(F.date_format(ts, "yyyyMMdd"), F.struct(*order)).alias("day")
    ).where(F.col("day").isNotNull())
    files = labels.select(label_file).distinct().withColumn(
        "day", F.explode(F.array_distinct(
            F.regexp_extract_all(F.element_at(F.split(label_file, "/"), -1), F.lit(r"(?=(\d{8}))"), F.lit(1))
        ))
    )
    dated = days.join(files, "day").select(capture, label_file)
    undated = days.join(dated, capture, "left_anti").select(capture)
    # Captures without a dated file use every file: captures x files, both listings.
    every = undated.withColumn("__k", F.lit(1)).join(
        labels.select(label_file).distinct().withColumn("__k", F.lit(1)), "__k"
    ).drop("__k")
    return labels.join(dated.unionByName(every.select(capture, label_file)), label_file)
