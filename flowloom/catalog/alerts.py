"""Decisions, alerts and end-to-end detection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators.features import assemble, flow_features, flow_meta
from ..operators.metrics import counts_by, run_counters
from ..operators.scoring import (
    WindowModel, argmax, as_json, class_probs, decide, fast_path, gate_window, pooled_window,
    prob_alerts, score_windows, train_window_model, window_alarms,
)
from ..operators.windows import sliding_behaviour, window_tensor
from ..functions.timefmt import micros
from ..plans.detect import detect
from ..session import scratch_path
from .registry import ENRICHED_SQL, enriched, eve, query
from .windows import BEHAVIOUR_SQL, GAP_S, SIZE, WITH_SESSIONS, prepared

THRESHOLD = 0.6


def weighted(df: DataFrame, weights, into: str) -> DataFrame:
    """Probabilities from non-negative class weights."""
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return df.withColumn("__total", total).withColumn(
        into, F.array(*[w / F.col("__total") for w in weights])
    ).drop("__total")


def demo_score(df: DataFrame) -> DataFrame:
    """A fixed scorer in place of a trained model, so that SQL can repeat it."""
    f = F.col("feat")
    return weighted(df, [
        0.0519 + 0.3137 * f["is_high_port"] + 0.2071 * f["app_dns"],
        0.2039 * f["upload_byte_ratio"] + 0.2977 * f["state_new"],
        0.3011 * f["download_pkt_ratio"],
        0.4973 * f["http_method_get"] + 0.1093 * f["is_well_known_port"],
        0.1987 * f["is_udp"],
        0.0541 + 0.2963 * f["tls_exists"] + 0.2017 * f["dns_exists"],
    ], "probs")


def demo_window_score(df: DataFrame) -> DataFrame:
    c = F.col
    return weighted(df, [
        0.1 + c("same_dst_port_ratio"), 0.1 + c("dst_ip_entropy") / 4.0, 0.1 + c("uri_entropy") / 3.0,
    ], "window_probs")


PROBS_SQL = f"""{ENRICHED_SQL}, weights AS (SELECT *,
  CAST(0.0519 AS DOUBLE) + CAST(0.3137 AS DOUBLE) * (CASE WHEN dest_port >= 49152 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + CAST(0.2071 AS DOUBLE) * (CASE WHEN app = 'dns' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w0,
  CAST(0.2039 AS DOUBLE) * (bts / greatest(tb, 1)) + CAST(0.2977 AS DOUBLE) * (CASE WHEN k3 = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w1,
  CAST(0.3011 AS DOUBLE) * (ptc / greatest(tp, 1)) AS w2,
  CAST(0.4973 AS DOUBLE) * (CASE WHEN hk % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + CAST(0.1093 AS DOUBLE) * (CASE WHEN dest_port < 1024 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w3,
  CAST(0.1987 AS DOUBLE) * (CASE WHEN proto = 'UDP' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w4,
  CAST(0.0541 AS DOUBLE) + CAST(0.2963 AS DOUBLE) * (CASE WHEN tk IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + CAST(0.2017 AS DOUBLE) * (CASE WHEN dk IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w5
  FROM enriched),
totals AS (SELECT *, w0 + w1 + w2 + w3 + w4 + w5 AS wt FROM weights),
scored AS (SELECT *, [w0 / wt, w1 / wt, w2 / wt, w3 / wt, w4 / wt, w5 / wt] AS probs FROM totals),
picked AS (SELECT *, 1.0 - probs[1] AS attack_prob, list_position(probs, list_max(probs)) - 1 AS cls FROM scored),
found AS (SELECT *, CASE cls WHEN 1 THEN 'DoS' WHEN 2 THEN 'DDoS' WHEN 3 THEN 'WebAttack' WHEN 4 THEN 'Infiltration' WHEN 5 THEN 'Bot' ELSE 'Benign' END AS flow_label
  FROM picked WHERE attack_prob >= {THRESHOLD}::DOUBLE AND cls <> 0)"""

# The window stage on the slow alerts: same window arithmetic, other input rows.
SLOW_SQL = PROBS_SQL + f""",
slow AS (SELECT * FROM found WHERE cls NOT IN (1, 2)),
s_open AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, seq) > {GAP_S * 1_000_000} THEN 1 ELSE 0 END AS opens FROM slow),
s_num AS (SELECT *, sum(opens) OVER (PARTITION BY src_ip ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS session FROM s_open),
s_row AS (SELECT *, CASE WHEN hk IS NULL THEN NULL ELSE '/p' || CAST(hk % 12 AS VARCHAR) END AS uri,
  row_number() OVER (PARTITION BY src_ip, session ORDER BY us, seq) AS rn FROM s_num),
s_win AS (SELECT *, list(dest_ip) OVER w AS dests, list(dest_port) OVER w AS ports,
  list(uri) FILTER (uri IS NOT NULL) OVER w AS uris FROM s_row
  WINDOW w AS (PARTITION BY src_ip, session ORDER BY rn ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW)),
s_w AS (SELECT *, CAST(0.1 AS DOUBLE) + list_max(map_values(list_aggregate(ports, 'histogram'))) / {SIZE}::DOUBLE AS a,
  CAST(0.1 AS DOUBLE) + list_entropy(dests) / 4.0 AS b,
  CAST(0.1 AS DOUBLE) + (CASE WHEN len(uris) > 0 THEN list_entropy(uris) ELSE 0.0 END) / 3.0 AS c FROM s_win),
s_max AS (SELECT *, greatest(a, b, c) / (a + b + c) AS best,
  CASE WHEN a >= b AND a >= c THEN 'Volumetric' WHEN b >= c THEN 'WebAttack' ELSE 'Bot' END AS name FROM s_w),
all_alerts AS (
  SELECT seq, flow_id, src_ip, dest_ip, src_port, dest_port, proto, app, dur, tb, us, cls, flow_label,
    'DoS/DDoS' AS label, round(attack_prob, 4) AS confidence, 'xgb_only' AS stage FROM found WHERE cls IN (1, 2)
  UNION ALL
  SELECT seq, flow_id, src_ip, dest_ip, src_port, dest_port, proto, app, dur, tb, us, cls, flow_label,
    CASE WHEN rn < {SIZE} THEN flow_label WHEN best < 0.5 THEN 'Generic Attack' ELSE name END,
    CASE WHEN rn < {SIZE} THEN round(attack_prob, 4) ELSE round(best, 4) END,
    CASE WHEN rn < {SIZE} THEN 'xgb_only' ELSE 'xgb+lstm' END FROM s_max)"""


def scored(spark, sf_dir):
    return demo_score(assemble(flow_features(flow_meta(enriched(spark, sf_dir)))))


def alerts(spark, sf_dir):
    return detect(eve(spark, sf_dir), demo_score, demo_window_score, threshold=THRESHOLD,
                  size=SIZE, gap_s=GAP_S)


@query("decisions", f"""WITH {PROBS_SQL} SELECT seq, round(attack_prob, 6) AS attack_prob, CAST(cls AS INTEGER) AS xgb_class,
  flow_label AS xgb_label, cls IN (1, 2) AS fast FROM found""")
def decisions(spark, sf_dir):
    df = decide(scored(spark, sf_dir), threshold=THRESHOLD)
    return df.select("seq", F.round("attack_prob", 6).alias("attack_prob"), "xgb_class", "xgb_label",
                     fast_path().alias("fast"))


@query("binary_decisions", f"""WITH {PROBS_SQL} SELECT seq, round(1.0 - (w0 + w2) / wt, 6) AS attack_prob, 'Generic Attack' AS xgb_label
FROM totals WHERE 1.0 - (w0 + w2) / wt >= {THRESHOLD}::DOUBLE""")
def binary_decisions(spark, sf_dir):
    p = F.col("probs")
    # The same weights as a two-class model.
    calm = F.get(p, F.lit(0)) + F.get(p, F.lit(2))
    two = scored(spark, sf_dir).withColumn("probs", F.array(calm, 1.0 - calm))
    df = decide(two, threshold=THRESHOLD, classes={0: "Benign", 1: "Attack"})
    return df.select("seq", F.round("attack_prob", 6).alias("attack_prob"), "xgb_label")


@query("alerts", f"""WITH {SLOW_SQL} SELECT us AS ts_us, 'ai_alert_hybrid' AS event_type, src_ip, dest_ip,
  CAST(src_port AS INTEGER) AS src_port, CAST(dest_port AS INTEGER) AS dest_port, proto, app AS app_proto, flow_id,
  label, confidence, stage, CAST(cls AS INTEGER) AS xgb_class, flow_label AS xgb_label, round(dur, 3) AS duration_s,
  CAST(tb AS BIGINT) AS total_bytes, round(tb / greatest(dur, 0.1), 1) AS byte_rate FROM all_alerts""")
def alerts_query(spark, sf_dir):
    df = alerts(spark, sf_dir).select("*", "ai.*").drop("ai")
    return df.withColumn("ts_us", micros(F.col("timestamp"))).drop("timestamp")


@query("alert_counts", f"WITH {SLOW_SQL} SELECT label, stage, count(*) AS n FROM all_alerts GROUP BY label, stage")
def alert_counts(spark, sf_dir):
    flat = alerts(spark, sf_dir).select(F.col("ai.label").alias("label"), F.col("ai.stage").alias("stage"))
    return counts_by(flat, "label", "stage")


@query("run_counters", f"""WITH {PROBS_SQL} SELECT (SELECT count(*) FROM flows) AS total, (SELECT count(*) FROM found) AS alerts,
  (SELECT count(*) FROM flows) - (SELECT count(*) FROM found) AS benign, CAST(0 AS BIGINT) AS skipped""")
def run_counters_query(spark, sf_dir):
    df = decide(scored(spark, sf_dir), threshold=THRESHOLD, keep_benign=True)
    return run_counters(df, F.col("is_alert"))


@query("prob_alerts", f"""WITH {PROBS_SQL} SELECT seq, CASE WHEN cls = 0 THEN 'Benign' ELSE CASE cls WHEN 1 THEN 'DoS' WHEN 2 THEN 'DDoS' WHEN 3 THEN 'WebAttack' WHEN 4 THEN 'Infiltration' ELSE 'Bot' END END AS label,
  round(attack_prob, 4) AS confidence, round(probs[2], 4) AS p_dos, round(probs[6], 4) AS p_bot
FROM picked WHERE attack_prob >= {THRESHOLD}::DOUBLE""")
def prob_alerts_query(spark, sf_dir):
    df = scored(spark, sf_dir)
    # The sequence rides along as the flow id, to compare row by row.
    keyed = df.withColumn("meta", F.col("meta").withField("flow_id", F.col("seq")))
    ai = F.col("ai")
    return prob_alerts(keyed, threshold=THRESHOLD).select(
        F.col("flow_id").alias("seq"), ai["label"].alias("label"), ai["confidence"].alias("confidence"),
        ai["class_probs"]["DoS"].alias("p_dos"), ai["class_probs"]["Bot"].alias("p_bot"),
    )


WINDOW_PROBS_SQL = f"""{BEHAVIOUR_SQL}, v AS (SELECT *, CAST(0.1 AS DOUBLE) + same_dst_port_ratio AS a,
  CAST(0.1 AS DOUBLE) + dst_ip_entropy / 4.0 AS b, CAST(0.1 AS DOUBLE) + uri_entropy / 3.0 AS c FROM behaviour),
labelled AS (SELECT *, CASE WHEN greatest(a, b, c) / (a + b + c) < 0.5 THEN 'Generic Attack' WHEN a >= b AND a >= c THEN 'Volumetric'
  WHEN b >= c THEN 'WebAttack' ELSE 'Bot' END AS class, round(greatest(a, b, c) / (a + b + c), 4) AS confidence FROM v)"""


@query("window_alarms", f"{WITH_SESSIONS}, {WINDOW_PROBS_SQL} SELECT src_ip, class, confidence, start_us, end_us FROM labelled")
def window_alarms_query(spark, sf_dir):
    df = window_alarms(demo_window_score(sliding_behaviour(prepared(spark, sf_dir), size=SIZE)))
    return df.select("src_ip", "class", "confidence", micros(F.col("window_start")).alias("start_us"),
                     micros(F.col("window_end")).alias("end_us"))


@query("window_score", f"""{WITH_SESSIONS}, {WINDOW_PROBS_SQL} SELECT seq, class AS window_label FROM labelled""")
def window_score_query(spark, sf_dir):
    """The same scorer as a batch function over the stacked windows."""
    def scorer(part):
        tail = np.array([w[0][-8:] for w in part["window"]], dtype=float).reshape(-1, 8)
        weights = 0.1 + np.stack([tail[:, 5], tail[:, 2] / 4.0, tail[:, 4] / 3.0], axis=1)
        return weights / weights.sum(axis=1, keepdims=True)

    rows = assemble(flow_features(prepared(spark, sf_dir)))
    windows = window_tensor(rows, size=SIZE).select("seq", "window")
    out = gate_window(score_windows(windows, scorer))
    return out.select("seq", "window_label")


@query("pooled_windows", f"""{WITH_SESSIONS}, {BEHAVIOUR_SQL} SELECT b.seq, 78 AS width, round((SELECT avg(CAST(s.dest_port AS DOUBLE)) FROM sessions s
  WHERE s.src_ip = b.src_ip AND s.session = b.session AND s.session_row BETWEEN b.session_row - {SIZE - 1} AND b.session_row), 4) AS mean_port
FROM behaviour b""")
def pooled_windows(spark, sf_dir):
    rows = assemble(flow_features(prepared(spark, sf_dir)))
    df = pooled_window(window_tensor(rows, size=SIZE).select("seq", "window"))
    return df.select("seq", F.size("pooled").alias("width"),
                     F.round(F.get("pooled", F.lit(18)), 4).alias("mean_port"))


WINDOW_CLASS_SQL = f"""{WITH_SESSIONS}, counted AS (SELECT seq, session_row,
  count_if(proto = 'TCP') OVER (PARTITION BY src_ip, session ORDER BY session_row ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW) AS tcp
  FROM sessions)"""


@query("window_model", f"""{WINDOW_CLASS_SQL} SELECT seq, CASE WHEN tcp <= 2 THEN 3 WHEN tcp = 4 THEN 5 ELSE 8 END AS label,
  CASE WHEN tcp <= 2 THEN 3 WHEN tcp = 4 THEN 5 ELSE 8 END AS predicted
FROM counted WHERE session_row >= {SIZE} AND (tcp <= 2 OR tcp = 4 OR tcp >= 6)""")
def window_model(spark, sf_dir):
    """Classes apart by the number of TCP flows in a window: learnt, saved, loaded, and all told right."""
    windows = window_tensor(assemble(flow_features(prepared(spark, sf_dir))), size=SIZE)
    tcp = F.aggregate(F.col("window"), F.lit(0.0), lambda a, r: a + F.get(r, F.lit(25)).cast("double"))
    label = F.when(tcp <= 2, 3).when(tcp == 4, 5).when(tcp >= 6, 8)
    known = windows.select("seq", "window", label.alias("label")).where("label IS NOT NULL")
    path = scratch_path(spark, "window-model")
    train_window_model(known, regularisation=0.0).save(spark, path)
    return WindowModel.load(spark, path).predict(known).select("seq", "label", "predicted")


@query("alert_json", f"""WITH {PROBS_SQL} SELECT seq, flow_label AS label, round(probs[2], 4) AS p_dos, round(probs[6], 4) AS p_bot,
  6 AS n_probs FROM found""")
def alert_json(spark, sf_dir):
    df = decide(scored(spark, sf_dir), threshold=THRESHOLD)
    text = as_json(df.select("seq", "xgb_label", class_probs("probs").alias("class_probs"),
                             argmax(F.col("probs")).alias("cls")))
    back = F.from_json("value", "seq long, xgb_label string, class_probs map<string,double>")
    return text.select(back.alias("a")).select(
        "a.seq", F.col("a.xgb_label").alias("label"), F.round(F.col("a.class_probs")["DoS"], 4).alias("p_dos"),
        F.round(F.col("a.class_probs")["Bot"], 4).alias("p_bot"), F.size("a.class_probs").alias("n_probs"),
    )
