"""Hand-computed feature, window and decision cases."""

import math

import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from flowloom.functions import lists
from flowloom.functions.coerce import finite, hex_value, number
from flowloom.functions.labels import attack_family, mentions, protocol
from flowloom.functions.timefmt import ARGUS_FORMATS, LABEL_CSV_FORMATS, micros, parse_ts
from flowloom.operators.enrich import enrich_flows
from flowloom.operators.features import assemble, flow_features, flow_meta, no_enrichment, window_meta
from flowloom.operators.scoring import decide, gate_window, window_alarms
from flowloom.operators.windows import (
    behaviour_of, label_windows, pane_behaviour, session_totals, sessionize, sliding_behaviour, tumbling_windows,
    window_tensor,
)
from flowloom.schema import EVE, FLOW_FEATURES, WINDOW_FEATURES
from flowloom.sources.eve import type_events
from flowloom.schema import EVE_TEXT

FLOW = """{"event_type":"flow","timestamp":"2024-01-01T00:00:05Z","flow_id":9,"src_ip":"10.0.0.2",
"src_port":54321,"dest_ip":"10.0.0.1","dest_port":"80","proto":"tcp","app_proto":"http","ip_v":0,
"flow":{"pkts_toserver":10,"pkts_toclient":8,"bytes_toserver":1200,"bytes_toclient":2400,
"start":"2024-01-01T00:00:00.000000+0000","end":"2024-01-01T00:00:02.5Z","state":"Established","reason":"TIMEOUT","age":2},
"tcp":{"tcp_flags_ts":"1b"}}"""
HTTP = """{"event_type":"http","timestamp":"2024-01-01T00:00:01Z","flow_id":9,
"http":{"http_method":"get","status":"503","http_content_type":"text/HTML; charset","url":"/a"}}"""
DNS = """{"event_type":"dns","timestamp":"2024-01-01T00:00:01Z","flow_id":9,
"dns":{"queries":[{"rrname":"a.b","rrtype":"aaaa"},{"rrname":""}],"rcode":"SERVFAIL"}}"""
TLS = '{"event_type":"tls","timestamp":"2024-01-01T00:00:01Z","flow_id":9}'


def events(spark, *lines):
    text = spark.createDataFrame([(i, " ".join(x.split())) for i, x in enumerate(lines)], "seq long, value string")
    parsed = text.select("seq", F.from_json("value", EVE_TEXT).alias("e")).select("e.*", "seq")
    return type_events(parsed, ["seq"])


def test_single_flow(spark):
    df = flow_features(no_enrichment(events(spark, FLOW)))
    f = df.select("feat.*").first()
    want = {
        "duration_s": 2.5, "total_pkts": 18, "total_bytes": 3600, "pkt_rate": 7.2, "byte_rate": 1440,
        "bytes_per_pkt": 200, "upload_byte_ratio": 1 / 3, "byte_asymmetry": 1 / 3,
        "pkt_size_variance_proxy": 180, "is_tcp": 1, "app_http": 1, "state_established": 1,
        "reason_timeout": 1, "is_well_known_port": 1, "is_ipv6": 0, "tcp_syn": 1, "tcp_ack": 1,
        "tcp_fin": 1, "tcp_rst": 0, "tcp_psh": 1, "dns_exists": 0, "tls_exists": 0,
    }
    for name, value in want.items():
        assert f[name] == pytest.approx(value), name
    vector = assemble(df).first()["features"]
    assert len(vector) == len(FLOW_FEATURES) == 70
    meta = flow_meta(events(spark, FLOW)).select("meta.*").first()
    assert (meta["duration_s"], meta["total_bytes"], meta["byte_rate"]) == (2.5, 3600, 1440.0)


def test_enriched_features_and_first_record_wins(spark):
    other = HTTP.replace('"get"', '"post"')
    df = flow_features(enrich_flows(events(spark, HTTP, other, DNS, TLS, FLOW, FLOW)))
    first, second = df.orderBy("seq").select("feat.*").collect()
    assert (first["http_method_get"], first["http_method_post"]) == (1, 0)
    assert (first["http_status_5xx"], first["http_content_type_html"]) == (1, 1)
    assert (first["tls_exists"], first["tls_sni_exists"]) == (1, 0)
    # The second query has no type and counts as another one.
    assert (first["dns_query_aaaa"], first["dns_query_other"], first["dns_query_a"]) == (1, 1, 0)
    assert (first["dns_rcode_other"], first["dns_rcode_noerror"]) == (1, 0)
    # One shot: the second flow with the id gets nothing.
    assert all(second[c] == 0 for c in ("http_method_get", "tls_exists", "dns_exists"))


def test_record_after_its_flow_serves_the_next_one(spark):
    df = enrich_flows(events(spark, FLOW, HTTP, FLOW))
    got = [r["enr_http"] is not None for r in df.orderBy("seq").collect()]
    assert got == [False, True]


def test_unusable_ids_are_kept_but_not_joined(spark):
    zero = [x.replace('"flow_id":9', '"flow_id":0') for x in (HTTP, FLOW)]
    none = [x.replace('"flow_id":9,', "") for x in (HTTP, FLOW)]
    df = enrich_flows(events(spark, *zero, *none))
    assert df.count() == 2 and df.where("enr_http is not null").count() == 0


def test_profiles(spark):
    base = enrich_flows(events(spark, HTTP, FLOW))
    train = flow_features(base, "train").select("feat.*").first()
    # Training reads content_type, which is absent here, and boolean flags.
    assert (train["http_content_type_html"], train["tcp_syn"], train["http_status_5xx"]) == (0, 0, 1)
    compact = flow_features(events(spark, FLOW), "compact")
    c = compact.select("feat.*").first()
    assert c["pkt_rate"] == pytest.approx(18 / (2 + 1e-6)) and c["dest_port_well_known"] == 1
    assert len(c) == 36 and len(assemble(compact, "compact").first()["features"]) == 70
    v6 = events(spark, FLOW.replace('"tcp"', '"ICMPv6"', 1))
    assert flow_features(v6, "base42").select("feat.is_icmp").first()[0] == 0
    assert flow_features(v6, "base42", fix_icmpv6=True).select("feat.is_icmp").first()[0] == 1


def test_missing_fields_are_zero(spark):
    f = flow_features(no_enrichment(events(spark, '{"event_type":"flow"}'))).select("feat.*").first()
    assert all(f[c] is not None and math.isfinite(f[c]) for c in FLOW_FEATURES)
    assert (f["duration_s"], f["is_unidirectional"], f["app_unknown"], f["is_same_port"]) == (0, 1, 1, 1)


def test_coercion(spark):
    df = spark.createDataFrame([("1b", "x"), ("zz", "2.5"), ("0x10", None)], "h string, n string")
    assert [r[0] for r in df.select(hex_value(F.col("h"))).collect()] == [27, 0, 16]
    assert [r[0] for r in df.select(number(F.col("n"), 7.0)).collect()] == [7.0, 2.5, 7.0]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.5,)], "x double")
    assert [r[0] for r in odd.select(finite(F.col("x"))).collect()] == [0.0, 0.0, 1.5]


def test_labels_and_times(spark):
    df = spark.createDataFrame([
        ("BENIGN",), ("DoS Hulk",), ("DDOS attack",), ("Web Attack XSS",), ("SSH-Bruteforce",), ("Other",),
    ], "l string")
    assert [r[0] for r in df.select(attack_family(F.col("l"))).collect()] == [
        "Benign", "DoS", "DDoS", "WebAttack", "BruteForce", "Other"]
    one = spark.createDataFrame([("17", "flow=From-Botnet", "2011/08/10 09:46:53.047277", "01/02/2018 03:04:05")],
                                "p string, l string, a string, c string")
    got = one.select(
        protocol(F.col("p")), mentions(F.col("l")), micros(parse_ts(F.col("a"), ARGUS_FORMATS)),
        micros(parse_ts(F.col("a"), ARGUS_FORMATS, tz="+02:00")), parse_ts(F.col("c"), LABEL_CSV_FORMATS),
        parse_ts(F.col("l")),
    ).first()
    assert got[0] == "udp" and got[1] is True and got[5] is None
    assert got[2] - got[3] == 7_200_000_000 and got[2] % 1_000_000 == 47277
    assert str(got[4]) == "2018-02-01 03:04:05"


def window_rows(spark, n, step=2, gap_at=None, gap=0):
    return spark.range(n).select(
        F.col("id").alias("seq"), F.lit("10.0.0.9").alias("src_ip"),
        F.timestamp_seconds(
            F.col("id") * step + (F.when(F.col("id") >= gap_at, gap).otherwise(0) if gap_at else 0)
        ).alias("ts"),
        F.lit("10.0.0.1").alias("dest_ip"), F.lit(80).alias("dest_port"),
        (500 + 10 * F.col("id")).alias("total_bytes"), F.array(F.lit("c2.example")).alias("dns_queries"),
        F.concat(F.lit("/api/v1/test_"), F.col("id").cast("string")).alias("http_uri"),
        F.lit("sni.example").alias("tls_sni"),
    )


EXPECTED = {
    "beacon_interval_mean": 2.0, "beacon_interval_std": 0.0, "dst_ip_entropy": 0.0,
    "dns_per_min": 1 / (78 / 60), "uri_entropy": math.log2(40), "same_dst_port_ratio": 1.0,
    "tls_sni_reuse": 0.975, "payload_size_variance": 13325.0,
}


def test_behaviour_case(spark):
    out = sliding_behaviour(sessionize(window_rows(spark, 40), ["src_ip"])).collect()
    assert len(out) == 1
    for name, value in EXPECTED.items():
        assert out[0][name] == pytest.approx(value), name
    assert str(out[0]["window_start"]) == "1970-01-01 00:00:00"
    assert (out[0]["window_end"] - out[0]["window_start"]).total_seconds() == 78


def test_behaviour_of_arrays_is_the_same(spark):
    rows_ = window_rows(spark, 40).withColumn("us", F.unix_micros("ts"))
    packed = rows_.agg(F.sort_array(F.collect_list(F.struct(
        "us", "dest_ip", "dest_port", "total_bytes", "dns_queries", "http_uri", "tls_sni"
    ))).alias("rows"))
    out = behaviour_of(packed).first()
    for name, value in EXPECTED.items():
        assert out[name] == pytest.approx(value), name
    single = behaviour_of(packed.withColumn("rows", F.slice("rows", 1, 1))).first()
    assert all(single[n] == 0 for n in WINDOW_FEATURES)


def test_no_window_before_it_is_full(spark):
    assert sliding_behaviour(sessionize(window_rows(spark, 39), ["src_ip"])).count() == 0
    partial = sliding_behaviour(sessionize(window_rows(spark, 39), ["src_ip"]), partial=True)
    assert partial.count() == 39


def test_sources_are_independent(spark):
    both = window_rows(spark, 40).unionByName(window_rows(spark, 15).withColumn("src_ip", F.lit("10.0.0.8")))
    out = sliding_behaviour(sessionize(both, ["src_ip"]))
    assert [r["src_ip"] for r in out.collect()] == ["10.0.0.9"]


@pytest.mark.parametrize("gap,sessions", [(299, 1), (300, 2)])
def test_gap_boundary(spark, gap, sessions):
    # Steps of 1 s, so the gap is 1 s more than what is added: 300 joins, 301 splits.
    df = sessionize(window_rows(spark, 31, step=1, gap_at=30, gap=gap), ["src_ip"])
    assert df.select("session").distinct().count() == sessions
    last = df.where("seq = 30").first()
    assert last["session_row"] == (31 if sessions == 1 else 1)
    totals = session_totals(df.drop("session"), ["src_ip"], "ts", 300, n=F.count(F.lit(1)))
    assert totals.count() == sessions


def test_tumbling_windows(spark):
    ready = sessionize(window_rows(spark, 95), ["src_ip"])
    assert rows(tumbling_windows(ready, total=F.sum("total_bytes")), "window_no", "window_rows") == [(0, 40), (1, 40)]


def test_window_labels(spark):
    # Rows: benign, then two of class 3 and two of class 1: a tie.
    labelled = window_rows(spark, 8).withColumn(
        "label", F.element_at(F.array(*[F.lit(x) for x in (0, 0, 0, 0, 3, 3, 1, 1)]), (F.col("seq") + 1).cast("int"))
    )
    out = label_windows(sessionize(labelled, ["src_ip"]), size=4)
    assert rows(out, "seq", "window_label") == [(4, 3), (5, 3), (6, 3), (7, 1)]


def test_window_tensor(spark):
    df = window_rows(spark, 41).withColumn(
        "features", F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: (i + F.col("seq")).cast("float"))
    )
    out = window_tensor(sessionize(df, ["src_ip"])).orderBy("seq").collect()
    assert len(out) == 2 and len(out[0]["window"]) == 40 and {len(r) for r in out[0]["window"]} == {78}
    assert [r[0] for r in out[1]["window"]][:2] == [2.0, 3.0]


def test_list_statistics(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), ([],), (["x"],)], "v array<string>")
    got = df.select(lists.entropy(F.col("v")), lists.modal_share(F.col("v")), lists.reuse_ratio(F.col("v"))).collect()
    assert tuple(got[0]) == (1.5, 0.5, 0.25)
    assert tuple(got[1]) == (0.0, 0.0, 0.0) and tuple(got[2]) == (0.0, 1.0, 0.0)


@pytest.mark.parametrize("probs,label,confidence", [
    ([0.85, 0.10, 0.05], "Volumetric", 0.85),
    ([0.42, 0.38, 0.20], "Generic Attack", 0.42),
    ([0.15, 0.80, 0.05], "WebAttack", 0.80),
])
def test_confidence_gate(spark, probs, label, confidence):
    df = spark.createDataFrame([("1.2.3.4", probs)], "src_ip string, window_probs array<double>").withColumns({
        "window_start": F.timestamp_seconds(F.lit(0)), "window_end": F.timestamp_seconds(F.lit(78)),
    })
    alarm = window_alarms(df)
    assert alarm.columns == ["src_ip", "class", "confidence", "window_start", "window_end"]
    assert tuple(alarm.first())[:3] == ("1.2.3.4", label, confidence)
    assert gate_window(df).first()["window_label"] == label


def test_decisions(spark):
    df = spark.createDataFrame([
        (1, [0.1, 0.5, 0.1, 0.1, 0.1, 0.1]), (2, [0.16, 0.1, 0.1, 0.44, 0.1, 0.1]),
        (3, [0.17, 0.1, 0.1, 0.43, 0.1, 0.1]), (4, [0.3, 0.2, 0.2, 0.1, 0.1, 0.1]),
    ], "id int, probs array<double>")
    assert rows(decide(df), "id", "xgb_label") == [(1, "DoS"), (2, "WebAttack")]
    # Above a low threshold, a benign top class still suppresses.
    assert rows(decide(df, threshold=0.5), "id") == [(1,), (2,), (3,)]
    kept = decide(df, keep_benign=True)
    assert rows(kept, "id", "is_alert") == [(1, True), (2, True), (3, False), (4, False)]
    binary = decide(df, threshold=0.5, classes={0: "Benign", 1: "Attack"})
    assert {r["xgb_label"] for r in binary.collect()} == {"Generic Attack"} and binary.count() == 4


def test_window_meta(spark):
    row = window_meta(enrich_flows(events(spark, DNS, FLOW))).first()
    assert row["dns_queries"] == ["a.b"] and row["total_bytes"] == 3600 and row["http_uri"] is None
    assert set(f.name for f in EVE) <= set(row.asDict())


@pytest.mark.parametrize("size, stride", [(6, 6), (6, 3), (8, 3), (7, 5), (5, 4), (9, 9)])
def test_panes_equal_frames(spark, size, stride):
    """Windows from panes and from row frames: sessions of all lengths, chunks, and rows with gaps between them."""
    flows = spark.range(400).select(
        F.col("id").alias("seq"), F.concat(F.lit("s"), F.col("id") % 7).alias("src_ip"),
        F.timestamp_micros((F.col("id") * F.col("id") % 9973) * 40_000_000).alias("ts"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("d"), F.col("id") % 3)).alias("dest_ip"),
        (F.col("id") * 7 % 4).cast("int").alias("dest_port"), (F.col("id") * 31 % 997).alias("total_bytes"),
        F.array(F.concat(F.lit("n"), F.col("id") % 4)).alias("dns_queries"),
        F.when(F.col("id") % 3 > 0, F.lit("/u")).otherwise("").alias("http_uri"), F.lit(None).cast("string").alias("tls_sni"))
    ready = sessionize(flows, ["src_ip"], gap_s=8000).where("session_row % 23 <> 22")
    last = Window.partitionBy("src_ip", "session").orderBy("session_row").rowsBetween(-(size - 1), 0)
    # Row frames do not see gaps; compare where there is none.
    whole = ready.withColumn("first", F.min("session_row").over(last)).where(F.col("session_row") - F.col("first") == size - 1).select("seq")
    from flowloom.schema import WINDOW_FEATURES

    def values(df):
        return df.join(whole, "seq").select("seq", "window_start", "window_end", "window_rows", "seqs", *[F.round(c, 5) for c in WINDOW_FEATURES])

    frames = sliding_behaviour(ready, size=size, stride=stride, keep={"seqs": F.collect_list("seq")})
    for chunk in (10**6, 12):
        panes = pane_behaviour(ready, ["src_ip"], "ts", size, stride, chunk, {"seqs": "seq"})
        assert panes.columns[:len(ready.columns)] == ready.columns
        assert rows(values(panes)) == rows(values(frames)) != []
        assert panes.count() == values(panes).count()


def test_disjoint_windows_need_no_frame(spark):
    out = sliding_behaviour(window_rows(spark, 120).withColumns({"session": F.lit(0), "session_row": F.col("seq") + 1}), stride=40)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.replace("window", "") and out.count() == 3
