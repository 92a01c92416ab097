"""Jobs end to end, streams against their batch twins, and split invariants."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowloom.catalog.alerts import THRESHOLD, demo_score, demo_window_score
from flowloom.catalog.scans import as_lines
from flowloom.functions.timefmt import micros
from flowloom.operators.enrich import enrich_flows
from flowloom.operators.labeling import (
    FIVE_TUPLE, five_tuple_key, folded_label, interval_label, nearest_label, rule_label,
)
from flowloom.operators.metrics import operating_curve, grid, relabel_report, run_counters
from flowloom.operators.sampling import group_folds, group_split
from flowloom.plans.detect import detect
from flowloom.plans.events_eve import events_as_eve
from flowloom.plans.relabel import botnet_flows, relabel, report
from flowloom.plans.window_dataset import window_dataset
from flowloom.sources.eve import stream_eve
from flowloom.sources.sinks import append_alerts
from flowloom.streaming.live import live_alerts
from flowloom.streaming.state import stream_enrich, stream_windows
from flowloom.operators.features import assemble, flow_features, window_meta


@pytest.fixture(scope="module")
def eve(spark, sf_dir):
    return events_as_eve(spark.read.parquet(f"{sf_dir}/events.parquet"))


def flow_table(spark, *items):
    """(seq, src, sport, dst, dport, proto, second)"""
    return spark.createDataFrame(list(items), (
        "seq int, src_ip string, src_port int, dest_ip string, dest_port int, proto string, t double"
    )).withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).drop("t")


def test_nearest_label_rules(spark):
    flows = flow_table(
        spark, (1, "a", 1, "b", 2, "TCP", 100.0), (2, "b", 2, "a", 1, "6", 104.0),
        (3, "a", 1, "b", 2, "tcp", 200.0), (4, "a", 1, "b", 2, "udp", 100.0),
    )
    labels = flow_table(
        spark, (1, "b", 2, "a", 1, "tcp", 95.0), (2, "a", 1, "b", 2, "tcp", 105.0), (3, "a", 1, "b", 2, "tcp", 105.0),
    ).withColumn("label", F.concat(F.lit("L"), "seq"))
    got = nearest_label(five_tuple_key(flows), five_tuple_key(labels), FIVE_TUPLE)
    # Flow 1 is 5 s from both sides: the first label in the file wins.
    assert rows(got, "seq", "gt_label") == [(1, "L1"), (2, "L2"), (3, None), (4, None)]
    swapped = flows.select("seq", F.col("dest_ip").alias("src_ip"), F.col("dest_port").alias("src_port"),
                           F.col("src_ip").alias("dest_ip"), F.col("src_port").alias("dest_port"), "proto", "ts")
    again = nearest_label(five_tuple_key(swapped), five_tuple_key(labels), FIVE_TUPLE)
    assert rows(again, "seq", "gt_label") == rows(got, "seq", "gt_label")


def test_folded_label_rules(spark):
    flows = flow_table(
        spark, (1, "a", 1, "b", 2, "T", 7200.0 + 30), (2, "a", 1, "b", 2, "T", 1800.0),
        (3, "x", 1, "b", 2, "T", 0.0), (4, "a", 1, "b", 2, "T", 3599.0),
    )
    labels = flow_table(spark, (1, "a", 1, "b", 2, "T", 600.0), (2, "a", 1, "b", 2, "T", 3 * 3600.0)).withColumn(
        "label", F.concat(F.lit("L"), "seq"))
    keys = ["src_ip", "src_port", "dest_ip", "dest_port", "proto"]
    got = folded_label(flows, labels, keys)
    # Hours off: still near. Nothing near: the first label. No such key: none. Around the hour: near.
    assert rows(got, "seq", "true_label") == [(1, "L2"), (2, "L1"), (3, None), (4, "L2")]


def test_rules_and_intervals(spark):
    day = 1_499_385_600.0  # midnight UTC
    flows = flow_table(
        spark, (1, "172.16.0.1", 1, "192.168.10.50", 80, "TCP", day), (2, "x", 1, "192.168.10.50", 80, "TCP", day + 1150 * 60),
        (3, "x", 1, "172.16.0.1", 80, "TCP", day + 1011 * 60), (4, "172.16.0.1", 1, "y", 1, "TCP", day + 800 * 60),
        (5, "192.168.10.9", 1, "205.174.165.73", 80, "TCP", day), (6, "205.174.165.73", 1, "y", 1, "UDP", day), (7, "x", 1, "y", 1, "TCP", day),
    )
    assert [r[1] for r in rows(rule_label(flows), "seq", "gt_label")] == [
        "DDoS", "DDoS", "PortScan", "Bot", "Bot", "DDoS", "Benign"]
    windows = flows.where("seq in (1, 4)").select(F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"))
    victims = spark.createDataFrame([("y",)], "ip string")
    got = interval_label(flows, windows, victims)
    assert rows(got.where("label = 1"), "seq") == [(4,), (6,), (7,)]


def test_relabel_job(spark, eve):
    flows = eve.where("event_type = 'flow'").withColumn("scenario", F.concat(F.lit("s"), F.col("user_id") % 3))
    start = F.timestamp_micros(micros(F.col("ts")) - 3_600_000_000)
    labels = flows.select(
        "scenario", "seq", start.alias("ts"), F.col("dest_ip").alias("src_ip"), F.col("dest_port").alias("src_port"),
        F.col("src_ip").alias("dest_ip"), F.col("src_port").alias("dest_port"), "proto",
        F.when(F.col("k") < 50, "flow=From-Botnet").otherwise("flow=From-Normal").alias("label"),
    ).where("scenario <> 's2'")
    families = spark.createDataFrame([("s0", "Zeus")], "scenario string, malware_family string")
    done = relabel(flows, labels, sync_clock=True, assume="Botnet", families=families)
    assert done.count() == flows.count()
    assert done.where("scenario <> 's2' and gt_label is null").count() == 0
    assert rows(done.where("scenario = 's2'").select("gt_label").distinct()) == [("Botnet",)]
    assert rows(done.select("scenario", "malware_family").distinct()) == [("s0", "Zeus"), ("s1", "Bot"), ("s2", "Bot")]
    assert botnet_flows(done).count() == done.where("gt_label like '%Bot%'").count()
    table = report(done).collect()
    assert table[-1]["scenario"] is None and table[-1]["flows"] == flows.count()
    assert sum(r["matched"] for r in table[:-1]) == table[-1]["matched"]
    unsynced = relabel(flows, labels)
    assert unsynced.where("gt_label is not null").count() < done.count() / 2


def test_window_dataset(spark, eve):
    flows = window_meta(assemble(flow_features(enrich_flows(eve, order=["seq"])))).withColumns({
        "label": F.col("k") % 4, "file": F.lit("f")})
    out = window_dataset(flows, size=5, gap_s=30 * 86_400, total_cap=90).cache()
    assert out.count() > 0 and set(out.columns) >= {"group_id", "label", "window"}
    first = out.first()
    assert len(first["window"]) == 5 and len(first["window"][0]) == 78
    every = window_dataset(flows, size=5, gap_s=30 * 86_400, total_cap=10**9)
    assert out.count() < every.count() and out.count() <= 90


def test_group_splits_keep_groups_whole(spark):
    df = spark.range(600).select(F.col("id"), (F.col("id") % 37).alias("g"), (F.col("id") % 37 % 3).alias("label"))
    split = group_split(df, "g", "label")
    assert split.groupBy("g").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    assert split.where("part = 'val'").select("label").distinct().count() == 3
    folds = group_folds(df, "g", "label", k=4)
    assert folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert folds.select("fold").distinct().count() == 4 and folds.count() == 600
    single = group_split(df.where("g = 0"), "g", "label")
    assert rows(single.select("part").distinct()) == [("val",)]


def test_curve_is_monotone(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("label"), (F.col("id") * 37 % 101 / 100.0).alias("score"))
    curve = operating_curve(df, "label", "score", grid(10, 90), 0, [1, 2]).orderBy("threshold").collect()
    for name in ("far", "recall_1", "recall_2", "pooled_recall", "macro_recall"):
        values = [r[name] for r in curve]
        assert all(a >= b for a, b in zip(values, values[1:])), name


def test_counters(spark):
    df = spark.sql("SELECT * FROM VALUES ('flow', true), ('flow', false), ('dns', false), ('stats', false), (NULL, false) AS t(event_type, a)")
    assert rows(run_counters(df, F.col("a"))) == [(2, 1, 1, 2)]
    table = relabel_report(spark.sql("SELECT * FROM VALUES ('s', 'x-Botnet'), ('s', NULL), ('t', 'Normal') AS t(scenario, gt_label)"))
    total = table.where("scenario is null").first()
    assert (total["flows"], total["matched"], total["botnet"], total["normal"], total["unmatched"]) == (3, 2, 1, 1, 1)


def land(spark, eve, path, segments=3):
    """The events as JSON segments in time order, one file each."""
    n = eve.count()
    for i in range(segments):
        part = eve.where((F.col("seq") >= n * i // segments) & (F.col("seq") < n * (i + 1) // segments))
        as_lines(part.orderBy("seq").coalesce(1)).write.text(f"{path}/{i}")


def drained(df, path):
    append_alerts(df, f"{path}/out", f"{path}/state").awaitTermination()
    return df.sparkSession.read.schema(df.schema).json(f"{path}/out")


def test_streams_match_batch_over_several_batches(spark, eve, tmp_path):
    land(spark, eve, tmp_path / "in")
    size, gap, keep = 5, 40 * 86_400, 90 * 86_400
    source = stream_eve(spark, f"{tmp_path}/in/*", max_files=1)
    batch = enrich_flows(eve, order=["seq"])
    enriched = drained(stream_enrich(source, keep, delay="90 days").select(
        "flow_id", "src_port", "enr_http.url", F.col("enr_tls").isNotNull().alias("tls")), tmp_path / "e")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(enriched) == key(batch.select("flow_id", "src_port", "enr_http.url", F.col("enr_tls").isNotNull().alias("tls")))

    alerts = drained(live_alerts(source, demo_score, demo_window_score, THRESHOLD, size=size, gap_s=gap,
                                 timeout_s=keep, delay="90 days"), tmp_path / "a")
    want = detect(eve, demo_score, demo_window_score, threshold=THRESHOLD, size=size, gap_s=gap)
    flat = ("flow_id", "src_port", "ai.label", "ai.stage", "ai.confidence", "ai.xgb_label")
    assert key(alerts.select(*flat)) == key(want.select(*flat))
    assert {r["stage"] for r in alerts.select("ai.stage").distinct().collect()} == {"xgb_only", "xgb+lstm"}
    assert {json.loads(x)["event_type"] for (x,) in alerts.select(F.to_json(F.struct("event_type"))).limit(5).collect()} == {"ai_alert_hybrid"}


def test_old_enrichment_expires(spark, tmp_path):
    def line(kind, second, **more):
        return json.dumps({"event_type": kind, "flow_id": 5, "timestamp": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z", **more})

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([
        line("http", 0, http={"url": "/old"}), line("http", 301, http={"url": "/new"}), line("flow", 302), line("flow", 303)]))
    out = drained(stream_enrich(stream_eve(spark, f"{tmp_path}/in")).select("timestamp", "enr_http.url"), tmp_path / "o")
    # A null is left out of the JSON, so the second flow has no URL.
    assert [r["url"] for r in out.orderBy("timestamp").collect()] == ["/new", None]


def test_cleared_buffer_and_features_in_windows(spark, eve, tmp_path):
    land(spark, eve, tmp_path / "in", 2)
    flows = window_meta(stream_enrich(stream_eve(spark, f"{tmp_path}/in/*", max_files=1), 10**7, delay="90 days"))
    framed = stream_windows(flows.withColumn("features", F.array(F.lit(1.0)).cast("array<float>")), size=4,
                            gap_s=10**7, fire="clear", with_features=True)
    out = drained(framed.select("src_ip", "window_rows", F.size("rows").alias("n"),
                                F.get("rows", F.lit(0))["features"].alias("f")), tmp_path / "o")
    assert out.where("n <> window_rows").count() == 0 and rows(out.select("f").distinct()) == [([1.0],)]
    per = out.groupBy("src_ip").agg(F.count("*").alias("n"), F.count_if(F.col("window_rows") == 4).alias("full"))
    assert all(r["full"] == r["n"] // 4 for r in per.collect())
