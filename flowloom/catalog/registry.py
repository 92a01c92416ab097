"""Query registration and the shared SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.enrich import enrich_flows
from ..plans.events_eve import events_as_eve
from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


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


def eve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_eve(table(spark, sf_dir, "events"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eve(spark, sf_dir).where(F.col("event_type") == "flow")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_flows(eve(spark, sf_dir), order=["seq"])


#: A total order of lineitem rows; order and line number alone repeat.
LINE_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def line_code() -> Column:
    """Row code that positions are mixed from."""
    return (
        F.pmod(F.col("l_orderkey"), F.lit(1 << 20)) * 1000003 + F.col("l_linenumber") * 10007
        + F.col("l_partkey") * 101 + F.col("l_suppkey")
    )


LINE_POSITION = (
    "((((l_orderkey % 1048576) * 1000003 + l_linenumber * 10007 + l_partkey * 101 + l_suppkey)"
    " % 2147483648) * 2654435761) % 4294967296"
)


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scored rows: class, score, and a predicted class."""
    lines = table(spark, sf_dir, "lineitem")
    turn = F.pmod(F.col("l_partkey") * 7 + F.col("l_orderkey"), F.lit(5))
    return lines.withColumns({
        "label": F.col("l_returnflag"),
        "score": F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17, F.lit(1000)) / 1000.0,
        "predicted": F.when(turn == 0, "A").when(turn == 1, "N").when(turn == 2, "R").otherwise(
            F.col("l_returnflag")
        ),
    })


# SQL building blocks --------------------------------------------------------

EVE_SQL = """
eve AS (
  SELECT event_id AS seq, event_id, user_id, value, epoch_us(ts) AS us,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
    CASE event_type WHEN 'signup' THEN 'http' WHEN 'view' THEN 'dns'
      WHEN 'click' THEN 'tls' ELSE 'flow' END AS kind,
    event_id // 5 AS flow_id
  FROM events
),
flows AS (
  SELECT seq, event_id, user_id, value, us, k, flow_id,
    '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS src_ip,
    '192.168.0.' || CAST(k % 16 AS VARCHAR) AS dest_ip,
    1024 + event_id % 50000 AS src_port,
    CASE k % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22
      WHEN 4 THEN 8080 ELSE 50000 END AS dest_port,
    CASE WHEN event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS proto,
    CASE k % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'tls' WHEN 2 THEN 'dns' ELSE 'failed' END AS app,
    k % 3 AS k3,
    CAST(1 + event_id % 17 AS DOUBLE) AS pts, CAST(event_id % 11 AS DOUBLE) AS ptc,
    floor(value * 100) AS bts, CAST(k * 37 AS DOUBLE) AS btc,
    floor(value) AS dur,
    1 + event_id % 17 + event_id % 11 AS tp, floor(value * 100) + k * 37 AS tb
  FROM eve WHERE kind = 'flow'
)"""

ENRICHED_SQL = EVE_SQL + """,
epochs AS (
  SELECT *, coalesce(sum(CASE WHEN kind = 'flow' THEN 1 ELSE 0 END) OVER (
    PARTITION BY flow_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch
  FROM eve WHERE flow_id <> 0
),
firsts AS (
  SELECT flow_id, epoch, arg_min(k, seq) FILTER (kind = 'http') AS hk,
    arg_min(k, seq) FILTER (kind = 'tls') AS tk, arg_min(k, seq) FILTER (kind = 'dns') AS dk
  FROM epochs WHERE kind <> 'flow' GROUP BY flow_id, epoch
),
enriched AS (
  SELECT f.*, r.hk, r.tk, r.dk FROM flows f
  LEFT JOIN epochs e ON e.seq = f.seq
  LEFT JOIN firsts r ON r.flow_id = e.flow_id AND r.epoch = e.epoch
)"""

LINES_SQL = """
lines AS (
  SELECT *, l_returnflag AS label,
    ((l_orderkey * 31 + l_linenumber * 17) % 1000) / 1000.0 AS score,
    CASE (l_partkey * 7 + l_orderkey) % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R'
      ELSE l_returnflag END AS predicted
  FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag FROM lineitem)
)"""


def flag_sql(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, for comparison across engines."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
        else F.col(f.name) for f in df.schema
    ])
