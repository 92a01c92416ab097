"""Readers and writers on small files."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowloom.operators.align import Scaler
from flowloom.operators.sampling import first_n_by_source
from flowloom.operators.scoring import train_trees
from flowloom.schema import DEFAULT_THRESHOLD
from flowloom.sources.eve import read_catalogue, read_eve, read_flow_lines, read_labeled_tree, read_scenarios, route
from flowloom.sources.labels import (
    match_capture_dates, read_attack_windows, read_binetflow, read_families, read_label_csv,
)
from flowloom.sources.sinks import (
    complete, load_bundle, pending, read_windows, save_bundle, write_alerts, write_by_label,
    write_metrics, write_scenarios, write_windows,
)


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def flow(i, **more):
    return json.dumps({"event_type": "flow", "flow_id": i, "src_port": str(i), **more})


def test_eve_scan_and_routing(spark, tmp_path):
    path = put(tmp_path / "eve.json", flow(1), "", "not json", '{"event_type": "http"}', '{"event_type": "stats"}',
               flow(2, timestamp="2024-01-01T00:00:00Z"))
    got = read_eve(spark, path)
    assert [r["flow_id"] for r in got.where("event_type = 'flow'").orderBy("seq").collect()] == [1, 2]
    assert rows(got.where("flow_id = 2"), "src_port") == [(2,)]
    assert read_eve(spark, path, keep_corrupt=True).where("is_corrupt").count() == 1
    assert [d.count() for d in route(got)] == [2, 1, 1]


def test_flow_line_prefilter(spark, tmp_path):
    tight = json.dumps({"event_type": "flow", "flow_id": 1}, separators=(",", ":"))
    path = put(tmp_path / "eve.json", tight, flow(2), '{"event_type":"http"}', '{"event_type":"flow", broken')
    assert rows(read_flow_lines(spark, path), "flow_id") == [(1,)]
    assert rows(read_flow_lines(spark, path, marker=None), "flow_id") == [(1,), (2,)]


def test_class_files_catalogue_and_scenarios(spark, tmp_path):
    for day in ("mon", "tue"):
        put(tmp_path / "tree" / day / "eve_DoS.json", flow(1), flow(2), flow(3))
    put(tmp_path / "tree" / "eve_Bot.json", flow(4))
    put(tmp_path / "tree" / "other.json", flow(5))
    tree = read_labeled_tree(spark, str(tmp_path / "tree"))
    assert rows(tree.groupBy("label").count()) == [("Bot", 1), ("DoS", 6)]
    sources = {"DoS": [str(tmp_path / "tree" / d / "eve_DoS.json") for d in ("mon", "tue")],
               "Bot": [str(tmp_path / "tree" / "eve_Bot.json")]}
    events, listing = read_catalogue(spark, sources, {"DoS": 2})
    capped = first_n_by_source(events, listing)
    assert rows(capped.groupBy("class").count()) == [("Bot", 1), ("DoS", 4)]
    assert set(r["flow_id"] for r in capped.where("class = 'DoS'").collect()) == {1, 2}
    put(tmp_path / "caps" / "s1" / "eve.json", flow(1))
    put(tmp_path / "caps" / "s2" / "deep" / "eve.json", flow(2))
    scen = read_scenarios(spark, str(tmp_path / "caps"))
    assert rows(scen, "scenario", "flow_id") == [("s1", 1), ("s2", 2)]


def test_binetflow(spark, tmp_path):
    head = "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label"
    line = "{},1.0,{},1.1.1.1,{},->,2.2.2.2,80,CON,0,0,1,1,1,flow=From-Botnet"
    path = put(tmp_path / "a.binetflow", head, "# note", "", "a,b,c", line.format("2011/08/10 09:46:53.047277", "TCP", "12"),
               line.format("bad", "17", "1"), line.format("2011-08-10 09:46:53", "17", "0x10"))
    got = read_binetflow(spark, path).orderBy("ts")
    assert [tuple(r) for r in got.select("proto", "src_port", "dest_port").collect()] == [("udp", 0, 80), ("tcp", 12, 80)]
    zoned = read_binetflow(spark, path, tz="+02:00", precision="second").orderBy("ts").collect()
    assert str(zoned[1]["ts"]) == "2011-08-10 07:46:53"


def test_label_csv(spark, tmp_path):
    full = put(tmp_path / "f.csv", "Src IP,Src Port,Dst IP,Dst Port,Protocol,Timestamp,Label",
               "1.1.1.1,5,2.2.2.2,80,6,14/02/2018 01:02:03,DoS Hulk", "1.1.1.1,x,2.2.2.2,80,6,14/02/2018 01:02:03,Bot",
               "1.1.1.1,5,2.2.2.2,80,6,never,Bot")
    got, has_key = read_label_csv(spark, full)
    assert has_key and rows(got, "src_port", "proto", "label") == [(5, "TCP", "DoS")]
    bare = put(tmp_path / "b.csv", " Destination Port,Protocol,Timestamp,Label", "53,17,2018-02-14 01:02:03,BENIGN")
    got, has_key = read_label_csv(spark, bare)
    assert not has_key and rows(got, "dest_port", "proto", "label") == [(53, "UDP", "Benign")]
    with pytest.raises(KeyError):
        read_label_csv(spark, put(tmp_path / "c.csv", "a,b", "1,2"))


def test_notes_windows_and_dates(spark, tmp_path):
    root = tmp_path / "caps"
    put(root / "one" / "README.md", "Malware: Zeus-1 sample")
    put(root / "two" / "notes.txt", "nothing")
    put(root / "three" / "a.html", "family  Neris")
    assert rows(read_families(spark, str(root))) == [("one", "Zeus-1"), ("three", "Neris"), ("two", "Bot")]
    path = put(tmp_path / "labels.json", json.dumps({
        "attack_windows": [{"start": "2024-01-01T00:00:00Z", "end": "2024-01-01T01:00:00Z"}], "victim_ips": ["a", "b"]}))
    windows, victims = read_attack_windows(spark, path)
    assert rows(victims) == [("a",), ("b",)] and str(windows.first()["end"]) == "2024-01-01 01:00:00"
    flows = spark.sql("SELECT * FROM VALUES ('x', TIMESTAMP'2011-08-10 01:00:00', 1), ('y', TIMESTAMP'2012-01-01 00:00:00', 1) AS t(scenario, ts, seq)")
    labels = spark.sql("SELECT * FROM VALUES ('/l/c20110810.binetflow', 1), ('/l/c20110811.binetflow', 2) AS t(file, v)")
    got = match_capture_dates(flows, labels)
    assert rows(got, "scenario", "v") == [("x", 1), ("y", 1), ("y", 2)]


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (1, 'DoS'), (2, NULL), (3, 'Bot') AS t(id, true_label)")
    out = str(tmp_path / "fan")
    write_by_label(df, out)
    assert rows(spark.read.json(out), "id", "part") == [(1, "DoS"), (2, "unmatched"), (3, "Bot")]
    write_alerts(df, str(tmp_path / "alerts"))
    write_alerts(df, str(tmp_path / "alerts"))
    write_metrics(df, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "alerts")).count() == 3
    windows = spark.sql("SELECT 'g' AS group_id, 1 AS label, array(array(1.0f, 2.0f)) AS window")
    write_windows(windows, str(tmp_path / "w"))
    assert read_windows(spark, str(tmp_path / "w")).first()["window"] == [[1.0, 2.0]]


def test_manifest_is_incremental(spark, tmp_path):
    root, manifest = str(tmp_path / "out"), str(tmp_path / "done")
    df = spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 2), ('c', 3) AS t(scenario, v)")
    complete(df.where("scenario = 'a'"), manifest, lambda d: write_scenarios(d, root))
    assert rows(pending(df, manifest), "scenario") == [("b",), ("c",)]
    complete(df.withColumn("v", F.col("v") * 10), manifest, lambda d: write_scenarios(d, root))
    assert rows(spark.read.parquet(root), "scenario", "v") == [("a", 1), ("b", 20), ("c", 30)]
    assert pending(df, manifest).count() == 0


def test_bundle_round_trip(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel

    df = spark.range(60).select(F.array(F.col("id") % 7, F.col("id") % 3).cast("array<double>").alias("features"),
                                (F.col("id") % 3).cast("int").alias("label"))
    scaler = Scaler.fit(df)
    model = train_trees(scaler.apply(df), "scaled", trees=3, depth=3)
    save_bundle(spark, str(tmp_path / "m"), model, scaler, {0: "a", 1: "b", 2: "c"}, None, "v1", {"f1": 0.5})
    got = load_bundle(spark, str(tmp_path / "m"), RandomForestClassificationModel)
    assert got["threshold"] == DEFAULT_THRESHOLD and got["classes"][2] == "c" and got["metrics"] == {"f1": 0.5}
    assert list(got["scaler"].mean) == list(scaler.mean) and got["model"].getNumTrees == 3
