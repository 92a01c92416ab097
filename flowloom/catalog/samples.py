"""Caps, samples, splits, quotas and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordering import mixed_position
from ..operators.sampling import (
    first_n, first_n_by_source, group_folds, group_split, ordered_split, sample_per_class,
    slice_rows, stratified_split, top_k, union_classes, union_sources, window_quota,
)
from .registry import (
    EVE_SQL, LINE_IDS, LINE_POSITION, LINES_SQL, flows, line_code, query, scored_lines, table,
)

IDS = ", ".join(LINE_IDS)
SEED_FREE = f"""{LINES_SQL}, ranked AS (SELECT *,
  row_number() OVER (PARTITION BY label ORDER BY {LINE_POSITION}, {IDS}) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM lines)"""


def _position():
    return mixed_position(line_code())


def _group_position(col: str):
    return mixed_position(F.col(col) * 7919 + 13)


def _group_position_sql(col: str) -> str:
    return f"((({col} * 7919 + 13) % 2147483648) * 2654435761) % 4294967296"


@query("first_n", f"""WITH {LINES_SQL} SELECT label, {IDS} FROM lines
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {IDS}) <= 500""")
def first_n_query(spark, sf_dir):
    return first_n(scored_lines(spark, sf_dir), ["label"], 500, LINE_IDS).select("label", *LINE_IDS)


@query("first_n_by_source", f"""WITH {EVE_SQL}, cat AS (SELECT src_ip AS file, CASE WHEN min(user_id) % 2 = 0 THEN 'DoS' ELSE 'Bot' END AS class,
  3 + min(user_id) % 11 AS cap FROM flows GROUP BY src_ip)
SELECT f.seq, c.class FROM flows f JOIN cat c ON c.file = f.src_ip
QUALIFY row_number() OVER (PARTITION BY c.file ORDER BY f.seq) <= c.cap""")
def first_n_by_source_query(spark, sf_dir):
    rows = flows(spark, sf_dir).select("seq", F.col("src_ip").alias("file"), "user_id")
    least = rows.groupBy("file").agg(F.min("user_id").alias("u"))
    catalogue = least.select(
        "file", F.when(F.col("u") % 2 == 0, "DoS").otherwise("Bot").alias("class"),
        (3 + F.col("u") % 11).alias("cap"),
    )
    return first_n_by_source(rows, catalogue).select("seq", "class")


@query("sample_per_class", f"WITH {SEED_FREE} SELECT label, {IDS} FROM ranked WHERE rn <= 700")
def sample_query(spark, sf_dir):
    out = sample_per_class(scored_lines(spark, sf_dir), "label", 700, LINE_IDS, position=_position())
    return out.select("label", *LINE_IDS)


@query("holdout_slice", f"""WITH {LINES_SQL} SELECT label, {IDS} FROM lines
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {IDS}) BETWEEN 201 AND 500""")
def holdout_query(spark, sf_dir):
    out = slice_rows(scored_lines(spark, sf_dir), 200, 300, LINE_IDS, ["label"])
    return out.select("label", *LINE_IDS)


@query("stratified_split", f"""WITH {SEED_FREE} SELECT {IDS}, label, CASE WHEN rn <= round(n * 0.7::DOUBLE) THEN 'train'
  WHEN rn <= round(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM ranked""")
def stratified_query(spark, sf_dir):
    out = stratified_split(
        scored_lines(spark, sf_dir), "label", {"train": 0.7, "val": 0.15, "test": 0.15}, LINE_IDS,
        position=_position(),
    )
    return out.select(*LINE_IDS, "label", "part")


@query("ordered_split", f"""WITH {LINES_SQL}, r AS (SELECT {IDS}, row_number() OVER (ORDER BY {IDS}) AS rn, count(*) OVER () AS n FROM lines)
SELECT {IDS}, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS part FROM r""")
def ordered_query(spark, sf_dir):
    return ordered_split(scored_lines(spark, sf_dir), 0.8, LINE_IDS).select(*LINE_IDS, "part")


GROUPS_SQL = f"""{LINES_SQL}, c AS (SELECT l_suppkey AS g, label, count(*) AS n FROM lines GROUP BY 1, 2),
dom AS (SELECT g, label AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, label) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY dominant ORDER BY {_group_position_sql('g')}, g) AS r,
  count(*) OVER (PARTITION BY dominant) AS groups FROM dom)"""


@query("group_split", f"""WITH {GROUPS_SQL} SELECT {IDS}, label, CASE WHEN r <= greatest(1, floor(groups * 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS part
FROM lines JOIN rk ON g = l_suppkey""")
def group_split_query(spark, sf_dir):
    out = group_split(scored_lines(spark, sf_dir), "l_suppkey", "label",
                      position=_group_position("l_suppkey"))
    return out.select(*LINE_IDS, "label", "part")


@query("group_folds", f"""WITH {GROUPS_SQL} SELECT {IDS}, label, CAST((r - 1) % 5 AS INTEGER) AS fold FROM lines JOIN rk ON g = l_suppkey""")
def group_folds_query(spark, sf_dir):
    out = group_folds(scored_lines(spark, sf_dir), "l_suppkey", "label",
                      position=_group_position("l_suppkey"))
    return out.select(*LINE_IDS, "label", "fold")


@query("window_quota", f"""WITH {LINES_SQL}, sizes AS (SELECT l_suppkey AS g, count(*) AS w FROM lines GROUP BY 1),
c AS (SELECT l_suppkey AS g, label, count(*) AS n FROM lines GROUP BY 1, 2),
dom AS (SELECT g, label AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, label) = 1),
spent AS (SELECT d.g, w, sum(w) OVER (PARTITION BY dominant ORDER BY {_group_position_sql('d.g')}, d.g ROWS UNBOUNDED PRECEDING) AS upto
  FROM dom d JOIN sizes s ON s.g = d.g),
take AS (SELECT g, least(w, 5000 - (upto - w)) AS t FROM spent WHERE 5000 - (upto - w) > 0)
SELECT {IDS} FROM lines JOIN take ON g = l_suppkey QUALIFY row_number() OVER (PARTITION BY g ORDER BY {IDS}) <= t""")
def window_quota_query(spark, sf_dir):
    out = window_quota(scored_lines(spark, sf_dir), "l_suppkey", "label", 5000, LINE_IDS,
                       position=_group_position("l_suppkey"))
    return out.select(*LINE_IDS)


@query("multi_source_union", f"""WITH {EVE_SQL} SELECT 0 AS class_id, event_id AS id, value AS amount FROM events
UNION ALL SELECT 1, l_orderkey, l_extendedprice FROM lineitem
UNION ALL SELECT 2, o_orderkey, o_totalprice FROM orders""")
def multi_source_union(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    lines = table(spark, sf_dir, "lineitem")
    return union_classes({
        0: events.select(F.col("event_id").alias("id"), F.col("value").alias("amount")),
        1: lines.select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount")),
        2: table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount")),
    })


@query("capped_domain_union", f"""WITH {SEED_FREE}
SELECT CASE label WHEN 'A' THEN 'capped' WHEN 'N' THEN 'whole' ELSE 'tight' END AS source_name, {IDS}
FROM ranked WHERE rn <= CASE label WHEN 'A' THEN 900 WHEN 'R' THEN 70 ELSE n END""")
def capped_domain_union(spark, sf_dir):
    lines = scored_lines(spark, sf_dir).select("label", *LINE_IDS)
    both = union_sources({
        "capped": (lines.where(F.col("label") == "A"), 900),
        "whole": (lines.where(F.col("label") == "N"), None),
        "tight": (lines.where(F.col("label") == "R"), 70),
    }, LINE_IDS, position=_position())
    return both.select("source_name", *LINE_IDS)


@query("top_k", f"SELECT {IDS}, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, {IDS} LIMIT 15")
def top_k_query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "lineitem").select(*LINE_IDS, "l_extendedprice"),
                 "l_extendedprice", 15, LINE_IDS)
