"""Late rows, evictions and counters of the streams, over several files and runs."""

import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowloom.sources.eve import stream_eve
from flowloom.streaming.live import live_alerts, observe_progress
from flowloom.streaming.progress import ProgressTotals
from flowloom.streaming.state import behind, stream_enrich


def line(kind, flow_id, second, **more):
    at = f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"
    own = {"flow": {"pkts_toserver": 1}} if kind == "flow" else {kind: {"url": f"/{second}"} if kind == "http" else {}}
    return json.dumps({"event_type": kind, "flow_id": flow_id, "timestamp": at, "src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "dest_port": second, **own, **more})


@pytest.fixture()
def segments(tmp_path):
    """Files by arrival: a minute early for the last lines of the second, two hours for those of the third."""
    (tmp_path / "in").mkdir()
    lines = [
        [line("http", 5, 7000), line("flow", 5, 7200), line("http", 6, 7210), line("flow", None, 7300)],
        [line("flow", 6, 7200), line("http", 5, 6899), line("flow", 5, 6900), line("flow", 5, 6899)],
        [line("flow", 5, 0), line("flow", 6, 7205), line("http", 9, 1), line("flow", None, 2), line("flow", 9, 2)],
    ]
    for i, part in enumerate(lines):
        path = tmp_path / "in" / f"{i}.json"
        path.write_text("\n".join(part))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return f"{tmp_path}/in"


def run(df, path, progress=None):
    out = df.writeStream.format("json").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    (progress or ProgressTotals()).follow(out)
    return df.sparkSession.read.schema(df.schema).json(f"{path}/out")


def test_no_flow_is_lost(spark, segments, tmp_path):
    progress = ProgressTotals()
    source = observe_progress(stream_eve(spark, segments, max_files=1))
    out = run(stream_enrich(source).select("flow_id", "dest_port", "late", "enr_http.url"), tmp_path / "e", progress)
    # 300 s behind is in time, 301 s is not. An id seen for the first time has no clock; rows without an id have none at all.
    assert rows(out.select(F.coalesce("flow_id", F.lit(0)), "dest_port", "late", F.coalesce("url", F.lit("-")))) == [
        (0, 2, False, "-"), (0, 7300, False, "-"), (5, 0, True, "-"), (5, 6899, True, "-"), (5, 6900, False, "-"), (5, 7200, False, "/7000"),
        (6, 7200, False, "/7210"), (6, 7205, False, "-"), (9, 2, False, "/1")]
    totals = progress.totals
    assert (totals["progress.rows"], totals["progress.flows"], totals["progress.records"]) == (13, 9, 4)
    assert (totals["enrichment.late_flows"], totals["enrichment.late_records"]) == (2, 1)
    assert totals["input_rows"] == 13 and totals["batches"] >= 3 and progress.rows_per_second > 0
    before = dict(totals)
    again = run(stream_enrich(source).select("flow_id", "dest_port", "late", "enr_http.url"), tmp_path / "e", progress)
    assert again.count() == 9 and progress.totals["input_rows"] == before["input_rows"]  # nothing new: nothing counted twice
    assert rows(progress.table(spark).where("counter = 'enrichment.late_flows'"), "value") == [(2,)]


def test_late_flows_alert(spark, segments, tmp_path):
    def score(df):
        return df.withColumn("probs", F.array(*[F.lit(x) for x in (0.05, 0.0, 0.0, 0.9, 0.05, 0.0)]).cast("array<double>"))

    def score_window(df):
        return df.withColumn("window_probs", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))

    out = run(live_alerts(stream_eve(spark, segments, max_files=1), score, score_window, 0.5, size=3), tmp_path / "a")
    got = out.groupBy("ai.stage", "ai.label").count()
    # Nine flows of one source. Those at 7200, 7300, 7200 and 7205 enter its buffer and fill it twice; the
    # others lie more than 300 s behind their id or the source, stay outside, and alert all the same.
    assert out.count() == 9 and rows(got) == [("xgb+lstm", "Bot", 2), ("xgb_only", "WebAttack", 7)]


def test_intervals_of_text():
    assert behind("300 seconds") == 300_000_000 and behind("40 days") == 40 * 86_400_000_000


def test_ids_share_a_group(spark, tmp_path):
    """Clocks, records, lateness and evictions stay apart where all ids are in one bucket."""
    lines = [
        [(5, "http", 100), (6, "tls", 100), (7, "flow", 90)],
        [(5, "flow", 110), (6, "flow", 1), (None, "flow", 2)],
        [(8, "flow", 200)], [(8, "flow", 210)],
    ]
    schema = "seq long, flow_id long, event_type string, timestamp timestamp, arrived timestamp, http struct<url:string>, tls struct<sni:string>, dns struct<rcode:string>"
    for n, part in enumerate(lines):
        texts = [json.dumps({
            "seq": 10 * n + i, "flow_id": flow_id, "event_type": kind, "timestamp": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z",
            "arrived": f"2024-01-0{n + 1}T00:00:00Z", **({kind: {}} if kind != "flow" else {}),
        }) for i, (flow_id, kind, s) in enumerate(part)]
        (tmp_path / "in").mkdir(exist_ok=True)
        path = tmp_path / "in" / f"{n}.json"
        path.write_text("\n".join(texts))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    progress = ProgressTotals()
    out = run(stream_enrich(source, delay="60 seconds", arrival="arrived", with_notes=True, timeout_s=90_000, buckets=1).select(
        "seq", "late", F.col("enr_http").isNotNull().alias("http"), F.col("enr_tls").isNotNull().alias("tls"), "note"), tmp_path / "b", progress)
    assert rows(out.where("seq IS NOT NULL").select("seq", "late", "http", "tls")) == [
        (2, False, False, False), (10, False, True, False), (11, True, False, False), (12, False, False, False),
        (20, False, False, False), (30, False, False, False)]
    # Id 7 came on the first day only, ids 5 and 6 last on the second; 8 is still held.
    assert progress.totals["enrichment.evicted"] == out.where("note = 'evicted'").count() == 3
