"""Whole jobs and the files between them: written by one, read back by the next."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from ..functions.timefmt import micros
from ..operators.align import Scaler
from ..operators.features import assemble, flow_features, label_columns
from ..operators.labeling import interval_label
from ..operators.scoring import score_flows, train_trees
from ..plans.detect import described_flows, detect
from ..plans.relabel import relabel
from ..plans.window_dataset import window_dataset
from ..schema import FLOW_CLASSES
from ..session import scratch_path
from ..sources.eve import read_scenarios
from ..sources.labels import read_attack_windows, read_families
from ..sources.sinks import (
    load_bundle, read_windows, save_bundle, write_alerts, write_metrics, write_windows,
)
from .alerts import SLOW_SQL, alerts
from .registry import EVE_SQL, eve, flows, query
from .scans import ISO
from .windows import GAP_S, SIZE, WITH_SESSIONS, prepared

SCENARIO = "'s' || CAST(user_id % 5 AS VARCHAR)"


def scenario():
    return F.concat(F.lit("s"), F.pmod(F.col("user_id"), F.lit(5)).cast("string"))


@query("window_dataset", f"""{WITH_SESSIONS}, counted AS (
  SELECT src_ip, session, session_row, sum(CAST(dest_port AS BIGINT)) OVER w AS port_sum,
    sum(CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END) OVER w AS c1,
    sum(CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END) OVER w AS c2,
    sum(CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END) OVER w AS c3 FROM sessions
  WINDOW w AS (PARTITION BY src_ip, session ORDER BY session_row ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW))
SELECT src_ip AS group_id, session, session_row, {SIZE} AS n_rows, 78 AS n_cols, CAST(port_sum AS DOUBLE) AS port_sum,
  CASE WHEN c1 >= c2 AND c1 >= c3 THEN 1 WHEN c2 >= c3 THEN 2 ELSE 3 END AS label
FROM counted WHERE session_row >= {SIZE} AND c1 + c2 + c3 > 0""")
def window_dataset_query(spark, sf_dir):
    """All attack windows, written and read back."""
    df = assemble(flow_features(prepared(spark, sf_dir))).withColumn("label", F.pmod(F.col("k"), F.lit(4)).cast("int"))
    path = scratch_path(spark, "windows")
    write_windows(window_dataset(df.drop("session", "session_row"), ["src_ip"], size=SIZE, gap_s=GAP_S), path)
    w = F.col("window")
    port = F.aggregate(w, F.lit(0.0), lambda acc, r: acc + F.get(r, F.lit(18)).cast("double"))
    return read_windows(spark, path).select(
        "group_id", "label", "session", "session_row", F.size(w).alias("n_rows"),
        F.size(F.get(w, F.lit(0))).alias("n_cols"), port.alias("port_sum"))


RELABEL_SQL = f"""WITH {EVE_SQL}, truth AS (
  SELECT {SCENARIO} AS scenario, us + 7200000000 + 1000000 AS us, 'flow=From-' || (CASE WHEN k % 3 = 0 THEN 'Botnet' ELSE 'Normal' END) AS label
  FROM flows WHERE event_id % 3 <> 0),
counts AS (SELECT {SCENARIO} AS scenario, count(*) AS total, count_if(event_id % 3 <> 0) AS matched,
  count_if(event_id % 3 <> 0 AND k % 3 = 0) AS botnet FROM flows GROUP BY 1)"""


@query("relabel_job", f"{RELABEL_SQL} SELECT scenario, total, matched, botnet FROM counts")
def relabel_job(spark, sf_dir):
    """Labels two hours and a second ahead on a foreign clock, ends swapped, keys unique per flow."""
    base = flows(spark, sf_dir).withColumns({
        "scenario": scenario(), "src_port": F.col("seq").cast("int"),
        "flow": F.col("flow").withField("start", F.col("ts")),
    })
    truth = base.where(F.col("event_id") % 3 != 0).select(
        "scenario", "seq", F.timestamp_micros(micros(F.col("ts")) + 7_201_000_000).alias("ts"), "proto",
        F.col("dest_ip").alias("src_ip"), F.col("dest_port").alias("src_port"),
        F.col("src_ip").alias("dest_ip"), F.col("src_port").alias("dest_port"),
        F.concat(F.lit("flow=From-"), F.when(F.pmod(F.col("k"), F.lit(3)) == 0, "Botnet").otherwise("Normal")).alias("label"))
    found = relabel(base, truth, sync_clock=True)
    return found.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("total"), F.count("gt_label").alias("matched"),
        F.count_if(F.col("gt_label").contains("Botnet")).alias("botnet"))


@query("alert_sink", f"WITH {SLOW_SQL} SELECT label, stage, count(*) AS n FROM all_alerts GROUP BY label, stage")
def alert_sink(spark, sf_dir):
    """Alerts written as JSON lines and read back."""
    path = scratch_path(spark, "alerts")
    write_alerts(alerts(spark, sf_dir), path)
    back = spark.read.json(path)
    return back.groupBy(F.col("ai.label").alias("label"), F.col("ai.stage").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


KNOWN_CLASS = "CASE WHEN proto = 'UDP' THEN 2 WHEN k3 = 2 THEN 4 ELSE 0 END"


@query("bundle_detection", f"""WITH {EVE_SQL}, told AS (SELECT *, {KNOWN_CLASS} AS cls FROM flows)
SELECT us AS ts_us, src_ip, flow_id, CASE cls WHEN 2 THEN 'DoS/DDoS' ELSE 'Infiltration' END AS label,
  CASE cls WHEN 2 THEN 'DDoS' ELSE 'Infiltration' END AS xgb_label, 1.0::DOUBLE AS confidence, 'xgb_only' AS stage
FROM told WHERE cls <> 0""")
def bundle_detection(spark, sf_dir):
    """A model of classes that two features tell apart: trained, bundled, loaded and served by detection."""
    events = eve(spark, sf_dir)
    known = F.when(F.col("proto") == "UDP", 2).when(F.pmod("k", F.lit(3)) == 2, 4).otherwise(0)
    train = described_flows(events).withColumn("label", known).select("features", "label")
    # The classes between are not in the data: an example of each keeps the model's ids those of the class map.
    shape = train.limit(1).withColumn("features", F.array_repeat(F.lit(-1.0).cast("float"), 70))
    filler = shape.withColumn("label", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    train = train.unionByName(filler)
    scaler = Scaler.fit(train)
    model = train_trees(scaler.apply(train), "scaled", trees=5, depth=4, weighted=False, featureSubsetStrategy="all")
    path = scratch_path(spark, "bundle")
    save_bundle(spark, path, model, scaler, FLOW_CLASSES, None, "v1", {"macro_f1": 1.0})
    bundle = load_bundle(spark, path, RandomForestClassificationModel)

    def score(df):
        return score_flows(bundle["scaler"].apply(df), bundle["model"], "scaled")

    found = detect(events, score, threshold=bundle["threshold"], classes=bundle["classes"])
    ai = F.col("ai")
    return found.select(
        micros(F.col("timestamp")).alias("ts_us"), "src_ip", "flow_id", ai["label"].alias("label"),
        ai["xgb_label"].alias("xgb_label"), F.round(ai["confidence"], 1).alias("confidence"), ai["stage"].alias("stage"))


@query("metrics_sink", f"WITH {EVE_SQL} SELECT app AS label, count(*) AS n FROM flows GROUP BY app")
def metrics_sink(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    counts = flows(spark, sf_dir).groupBy(F.col("app_proto").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    write_metrics(counts, path)
    return spark.read.json(path).select("label", "n")


@query("label_metadata", f"""WITH {EVE_SQL} SELECT seq, 'bench' AS dataset, {SCENARIO} AS scenario,
  CASE WHEN k % 2 = 0 THEN 'Bot' END AS label FROM flows""")
def label_metadata(spark, sf_dir):
    df = label_columns(flows(spark, sf_dir), dataset="bench", scenario=scenario(), label=F.when(F.pmod(F.col("k"), F.lit(2)) == 0, "Bot"))
    return df.select("seq", "dataset", "scenario", "label")


def written_by_scenario(spark, df, name):
    """Text lines below one folder per scenario."""
    root = scratch_path(spark, name)
    df.select("scenario", "value").write.partitionBy("scenario").text(root)
    return root


@query("scenario_scan", f"""WITH {EVE_SQL} SELECT 'scenario=' || {SCENARIO} AS scenario, kind AS event_type, count(*) AS n,
  CAST(sum(flow_id) AS BIGINT) AS ids FROM eve GROUP BY 1, 2""")
def scenario_scan(spark, sf_dir):
    """Events of all scenarios in one scan, the scenario from the path."""
    events = eve(spark, sf_dir).withColumn("scenario", scenario())
    wanted = ["event_type", "flow_id", "src_ip", "dest_ip", "timestamp", "flow", "http", "tls", "dns"]
    lines = events.select("scenario", F.to_json(F.struct(*wanted), {"timestampFormat": ISO}).alias("value"))
    read = read_scenarios(spark, written_by_scenario(spark, lines, "captures"), name_glob="part-*")
    return read.groupBy("scenario", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("flow_id").alias("ids"))


@query("capture_families", f"""WITH {EVE_SQL}, c AS (SELECT {SCENARIO} AS scenario, count(*) AS n FROM flows GROUP BY 1)
SELECT 'scenario=' || scenario AS scenario, CASE WHEN n % 2 = 0 THEN 'Fam-' || CAST(n AS VARCHAR) ELSE 'Bot' END AS malware_family FROM c""")
def capture_families(spark, sf_dir):
    """Notes that name a family, and notes that do not."""
    counts = flows(spark, sf_dir).groupBy(scenario().alias("scenario")).agg(F.count(F.lit(1)).alias("n"))
    note = F.when(F.col("n") % 2 == 0, F.concat(F.lit("Probable Malware: Fam-"), F.col("n"), F.lit(" seen"))).otherwise("no remarks")
    notes = counts.select("scenario", note.alias("value"))
    return read_families(spark, written_by_scenario(spark, notes, "notes"))


@query("attack_window_file", f"""WITH {EVE_SQL},
w AS (SELECT min(us) AS a, max(us) AS b FROM flows WHERE value > 60 GROUP BY us // 86400000000),
v AS (SELECT DISTINCT dest_ip AS ip FROM flows WHERE value > 250)
SELECT seq, CASE WHEN EXISTS (SELECT 1 FROM w WHERE us BETWEEN a AND b)
  AND (src_ip IN (SELECT ip FROM v) OR dest_ip IN (SELECT ip FROM v)) THEN 1 ELSE 0 END AS label FROM flows""")
def attack_window_file(spark, sf_dir):
    """Windows and victims go through a labels file: one window per day."""
    base = flows(spark, sf_dir)
    stamp = lambda c: F.date_format(c, ISO)
    windows = base.where(F.col("value") > 60).groupBy(F.to_date("ts")).agg(
        stamp(F.min("ts")).alias("start"), stamp(F.max("ts")).alias("end"))
    listed = windows.agg(F.collect_list(F.struct("start", "end")).alias("attack_windows"))
    victims = base.where(F.col("value") > 250).agg(F.collect_set("dest_ip").alias("victim_ips"))
    path = scratch_path(spark, "labels-json")
    listed.join(victims).coalesce(1).write.json(path)
    spans, hosts = read_attack_windows(spark, path)
    return interval_label(base.select("seq", "ts", "src_ip", "dest_ip"), spans, hosts).select("seq", "label")
