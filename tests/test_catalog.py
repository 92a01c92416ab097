"""The driver contract: queries run and equal their SQL checks.

A representative of each family by default; all of them with FLOWLOOM_FULL=1.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
from check_queries import TABLES, compare

# Covered by their own tests, and slow to start.
SLOW = {"train_and_score", "cross_validated_f1", "stream_enrich", "stream_windows", "stream_tumbling",
        "stream_alerts"}
USUAL = {
    "flow_features", "enriched_features", "compact_features", "timestamp_formats", "sessionize",
    "sliding_behaviour", "window_labels", "nearest_label", "degraded_key_label", "clock_offset",
    "interval_label", "scenario_report", "class_report", "pr_curve", "operating_curve",
    "leakage_audit", "first_n", "sample_per_class", "stratified_split", "group_split",
    "window_quota", "covariance", "featurewise_rescale", "alerts", "prob_alerts", "scan_eve",
    "capture_dates",
}
NAMES = [
    n for n in contract.queries()
    if n in USUAL or (os.environ.get("FLOWLOOM_FULL") and n not in SLOW)
]


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, tables, name):
    note, _, ok = compare(
        spark, tables, name, contract.queries()[name], contract.oracle_sql().get(name), sf_dir
    )
    assert ok, note


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    out = contract.entry(spark)
    assert out.columns == ["label", "stage", "n"] and out.count() > 0
