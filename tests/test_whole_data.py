"""Defaults drop nothing: mixed headers, missing endpoints, unlisted classes, no quota."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from flowloom.operators.windows import attack_classes, behaviour_of, label_windows, sessionize, session_totals, sliding_behaviour
from flowloom.plans.window_dataset import window_dataset
from flowloom.operators.features import window_meta
from flowloom.schema import EVE
from flowloom.sources.eve import live_order
from flowloom.sources.labels import read_label_csv


def put(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_label_files_with_other_headers(spark, tmp_path):
    put(tmp_path / "a.csv", "Dst Port,Protocol,Timestamp,Label", "80,6,14/02/2018 01:02:03,DoS Hulk")
    put(tmp_path / "b.csv", "Label,Timestamp,Destination Port,Protocol", "Bot,14/02/2018 01:02:03,443,17")
    got, full = read_label_csv(spark, str(tmp_path))
    assert not full and rows(got, "dest_port", "proto") == [(80, "TCP"), (443, "UDP")]
    one = tmp_path / "full"
    one.mkdir()
    put(one / "a.csv", "Src IP,Src Port,Dst IP,Dst Port,Protocol,Timestamp,Label", "1.1.1.1,5,2.2.2.2,80,6,14/02/2018 01:02:03,Bot")
    put(one / "b.csv", "Dst IP,Dst Port,Src IP,Src Port,Protocol,Timestamp,Label", "4.4.4.4,81,3.3.3.3,6,6,14/02/2018 01:02:03,Bot")
    got, full = read_label_csv(spark, str(one))
    assert full and rows(got, "src_ip", "src_port", "dest_ip", "dest_port") == [("1.1.1.1", 5, "2.2.2.2", 80), ("3.3.3.3", 6, "4.4.4.4", 81)]


def flows(spark, n=8):
    """Every second flow has no address and no port."""
    odd = F.col("id") % 2 == 1
    raw = spark.range(n).select(
        F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.lit("s").alias("src_ip"),
        F.when(~odd, "d").alias("dest_ip"), F.when(~odd, 80).alias("dest_port"))
    for f in EVE:
        if f.name not in raw.columns:
            raw = raw.withColumn(f.name, F.lit(None).cast(f.dataType))
    for kind in ("http", "tls", "dns"):
        raw = raw.withColumn(f"enr_{kind}", F.col(kind))
    return window_meta(raw)


def test_missing_endpoints_count(spark):
    last = sliding_behaviour(sessionize(flows(spark), ["src_ip"]), size=8).first()
    assert last["dst_ip_entropy"] == pytest.approx(1.0) and last["same_dst_port_ratio"] == pytest.approx(0.5)
    item = F.struct(F.unix_micros("ts").alias("us"), "dest_ip", "dest_port", "total_bytes", "dns_queries", "http_uri", "tls_sni")
    packed = flows(spark).groupBy("src_ip").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    held = behaviour_of(packed).first()
    assert held["dst_ip_entropy"] == pytest.approx(1.0) and held["same_dst_port_ratio"] == pytest.approx(0.5)


def test_empty_window(spark):
    packed = flows(spark).groupBy("src_ip").agg(F.collect_list(F.struct(
        F.unix_micros("ts").alias("us"), "dest_ip", "dest_port", "total_bytes", "dns_queries", "http_uri", "tls_sni")).alias("rows"))
    out = behaviour_of(packed.withColumn("rows", F.slice("rows", 1, 0))).first()
    assert out["payload_size_variance"] == 0.0 and out["dst_ip_entropy"] == 0.0


def test_every_class_votes(spark):
    ready = sessionize(flows(spark).withColumn("label", F.when(F.col("seq") >= 4, 4).otherwise(0)), ["src_ip"])
    assert attack_classes(ready) == [4]
    assert rows(label_windows(ready, size=4), "seq", "window_label") == [(4, 4), (5, 4), (6, 4), (7, 4)]
    assert label_windows(ready.withColumn("label", F.lit(0)), size=4).count() == 0


def test_window_dataset_without_quota(spark):
    vectors = F.array(*[F.col("seq").cast("float")] * 70)
    df = flows(spark, 30).withColumns({"label": (F.col("seq") % 7).cast("int"), "file": F.lit("f"), "features": vectors})
    out = window_dataset(df, size=5)
    want = label_windows(sessionize(df, ["file", "src_ip"]), ["file", "src_ip"], size=5)
    assert rows(out, "session_row", "label") == rows(want, "session_row", "window_label") and out.count() == 26
    first = out.where("session_row = 9").first()["window"]
    assert [r[0] for r in first] == [4, 5, 6, 7, 8] and len(first[0]) == 78
    few = window_dataset(df.withColumn("label", F.when(F.col("seq") == 29, 9).otherwise(0)), size=5)
    assert rows(few, "session_row", "label") == [(30, 9)]


def test_live_order(spark):
    """Records of an instant come before its flow, and differ by any field."""
    def row(kind, **more):
        out = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in EVE])
        return out.withColumns({"event_type": F.lit(kind), "flow_id": F.lit(9).cast("long"), **more})

    def url(u):
        http = next(f.dataType for f in EVE if f.name == "http")
        return F.from_json(F.lit('{"url": "%s"}' % u), http)

    events = row("http", http=url("/a")).unionByName(row("http", http=url("/b"))).unionByName(row("http", http=url("/a"))).unionByName(row("flow"))
    got = [r[0] for r in events.select(live_order()).collect()]
    assert got[0] == got[2] != got[1] and max(got[:3]) < got[3]


def test_session_totals_of_a_heavy_source(spark):
    df = flows(spark, 60)
    small = session_totals(df, ["src_ip"], "ts", 300, max_rows=16, n=F.count(F.lit(1)))
    assert rows(small, "src_ip", "session", "n") == [("s", 0, 60)]
