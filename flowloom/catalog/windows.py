"""Sessions and count windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timefmt import micros
from ..operators.features import assemble, flow_features, window_meta
from ..operators.windows import (
    label_windows, session_totals, sessionize, sliding_behaviour, tumbling_windows, window_tensor,
)
from ..schema import WINDOW_FEATURES
from .registry import ENRICHED_SQL, EVE_SQL, enriched, flows, query, rounded

# One flow per source per day in the table, hence a long gap and a short window.
GAP_S = 172_800
SIZE = 8

SESSIONS_SQL = f"""
opened AS (
  SELECT *, CASE WHEN us - lag(us) OVER w > {GAP_S * 1_000_000} THEN 1 ELSE 0 END AS opens
  FROM enriched WINDOW w AS (PARTITION BY src_ip ORDER BY us, seq)
),
numbered AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY src_ip ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
  FROM opened
),
sessions AS (
  SELECT *, row_number() OVER (PARTITION BY src_ip, session ORDER BY us, seq) AS session_row
  FROM numbered
)"""
WITH_SESSIONS = f"WITH {ENRICHED_SQL}, {SESSIONS_SQL}"


def sessions(spark, sf_dir):
    return sessionize(enriched(spark, sf_dir), ["src_ip"], "ts", ["seq"], GAP_S)


def prepared(spark, sf_dir):
    return window_meta(sessions(spark, sf_dir))


@query("sessionize", f"{WITH_SESSIONS} SELECT seq, src_ip, session, session_row FROM sessions")
def sessionize_query(spark, sf_dir):
    return sessionize(flows(spark, sf_dir), ["src_ip"], "ts", ["seq"], GAP_S).select(
        "seq", "src_ip", "session", "session_row"
    )


@query("session_totals", f"""{WITH_SESSIONS} SELECT src_ip, min(us) AS start_us, count(*) AS flows,
  round(sum(value), 4) AS value FROM sessions GROUP BY src_ip, session""")
def session_totals_query(spark, sf_dir):
    raw = flows(spark, sf_dir)
    out = session_totals(raw, ["src_ip"], "ts", GAP_S, flows=F.count(F.lit(1)), value=F.sum("value"))
    return out.select("src_ip", micros(F.col("session_start")).alias("start_us"), "flows",
                      F.round("value", 4).alias("value"))


BEHAVIOUR_SQL = f"""
steps AS (
  SELECT *, (us - lag(us) OVER (PARTITION BY src_ip, session ORDER BY session_row)) / 1e6 AS step,
    CASE WHEN dk IS NULL THEN NULL ELSE 'h' || CAST(dk % 20 AS VARCHAR) END AS dns,
    CASE WHEN hk IS NULL THEN NULL ELSE '/p' || CAST(hk % 12 AS VARCHAR) END AS uri,
    CASE WHEN tk % 8 <> 0 THEN 's' || CAST(tk % 8 AS VARCHAR) END AS sni
  FROM sessions
),
framed AS (
  SELECT seq, src_ip, session, session_row, us, min(us) OVER w AS start_us,
    avg(CASE WHEN step > 0 THEN step END) OVER d AS m,
    stddev_pop(CASE WHEN step > 0 THEN step END) OVER d AS s,
    sum(CASE WHEN step > 0 THEN step END) OVER d AS span,
    var_pop(tb) OVER w AS v,
    list(dest_ip) OVER w AS dests, list(dest_port) OVER w AS ports,
    list(dns) FILTER (dns IS NOT NULL) OVER w AS names,
    list(uri) FILTER (uri IS NOT NULL) OVER w AS uris,
    list(sni) FILTER (sni IS NOT NULL) OVER w AS snis
  FROM steps
  WINDOW w AS (PARTITION BY src_ip, session ORDER BY session_row ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW),
    d AS (PARTITION BY src_ip, session ORDER BY session_row ROWS BETWEEN {SIZE - 2} PRECEDING AND CURRENT ROW)
),
behaviour AS (
  SELECT seq, src_ip, session, session_row, start_us, us AS end_us,
    coalesce(m, 0) AS beacon_interval_mean, coalesce(s, 0) AS beacon_interval_std,
    coalesce(list_entropy(dests), 0) AS dst_ip_entropy,
    coalesce(len(list_distinct(names)), 0) / (greatest(coalesce(span, 0), 1) / 60.0) AS dns_per_min,
    CASE WHEN len(uris) > 0 THEN list_entropy(uris) ELSE 0 END AS uri_entropy,
    list_max(map_values(list_aggregate(ports, 'histogram'))) / {SIZE}::DOUBLE AS same_dst_port_ratio,
    CASE WHEN len(snis) > 0 THEN 1 - len(list_distinct(snis)) / len(snis)::DOUBLE ELSE 0 END AS tls_sni_reuse,
    v AS payload_size_variance
  FROM framed WHERE session_row >= {SIZE}
)"""
ROUNDED_BEHAVIOUR = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in WINDOW_FEATURES)


@query("sliding_behaviour",
       f"{WITH_SESSIONS}, {BEHAVIOUR_SQL} SELECT seq, src_ip, start_us, end_us, {ROUNDED_BEHAVIOUR} FROM behaviour")
def sliding_behaviour_query(spark, sf_dir):
    df = sliding_behaviour(prepared(spark, sf_dir), size=SIZE)
    return rounded(df.select(
        "seq", "src_ip", micros(F.col("window_start")).alias("start_us"),
        micros(F.col("window_end")).alias("end_us"), *WINDOW_FEATURES,
    ))


@query("strided_windows",
       f"{WITH_SESSIONS}, {BEHAVIOUR_SQL} SELECT seq, src_ip, round(CAST(dst_ip_entropy AS DOUBLE), 5) AS dst_ip_entropy FROM behaviour WHERE (session_row - {SIZE}) % 3 = 0")
def strided_windows(spark, sf_dir):
    df = sliding_behaviour(prepared(spark, sf_dir), size=SIZE, stride=3)
    return rounded(df.select("seq", "src_ip", "dst_ip_entropy"), 5)


@query("strided_behaviour",
       f"{WITH_SESSIONS}, {BEHAVIOUR_SQL} SELECT seq, src_ip, start_us, end_us, {ROUNDED_BEHAVIOUR} FROM behaviour WHERE (session_row - {SIZE}) % 2 = 0")
def strided_behaviour(spark, sf_dir):
    """All eight values of overlapping windows, from panes."""
    df = sliding_behaviour(prepared(spark, sf_dir), size=SIZE, stride=2)
    return rounded(df.select("seq", "src_ip", micros(F.col("window_start")).alias("start_us"),
                             micros(F.col("window_end")).alias("end_us"), *WINDOW_FEATURES))


@query("disjoint_behaviour",
       f"{WITH_SESSIONS}, {BEHAVIOUR_SQL} SELECT seq, src_ip, start_us, end_us, {ROUNDED_BEHAVIOUR} FROM behaviour WHERE session_row % {SIZE} = 0")
def disjoint_behaviour(spark, sf_dir):
    """Windows one after the other: one aggregate."""
    df = sliding_behaviour(prepared(spark, sf_dir), size=SIZE, stride=SIZE)
    return rounded(df.select("seq", "src_ip", micros(F.col("window_start")).alias("start_us"),
                             micros(F.col("window_end")).alias("end_us"), *WINDOW_FEATURES))


@query("window_labels", f"""{WITH_SESSIONS}, counted AS (
  SELECT seq, src_ip, session_row,
    sum(CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END) OVER w AS c1,
    sum(CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END) OVER w AS c2,
    sum(CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END) OVER w AS c3 FROM sessions
  WINDOW w AS (PARTITION BY src_ip, session ORDER BY session_row ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW))
SELECT seq, src_ip, CASE WHEN c1 >= c2 AND c1 >= c3 THEN 1 WHEN c2 >= c3 THEN 2 ELSE 3 END AS window_label
FROM counted WHERE session_row >= {SIZE} AND c1 + c2 + c3 > 0""")
def window_labels(spark, sf_dir):
    labelled = sessions(spark, sf_dir).withColumn("label", F.pmod(F.col("k"), F.lit(4)))
    return label_windows(labelled, size=SIZE).select("seq", "src_ip", "window_label")


@query("tumbling_windows", f"""{WITH_SESSIONS} SELECT src_ip, session, (session_row - 1) // {SIZE} AS window_no,
  min(us) AS start_us, max(us) AS end_us, CAST(sum(tb) AS BIGINT) AS bytes
FROM sessions GROUP BY 1, 2, 3 HAVING count(*) = {SIZE}""")
def tumbling_query(spark, sf_dir):
    df = tumbling_windows(prepared(spark, sf_dir), size=SIZE, bytes=F.sum("total_bytes"))
    return df.select("src_ip", "session", "window_no", micros(F.col("window_start")).alias("start_us"),
                     micros(F.col("window_end")).alias("end_us"), "bytes")


@query("window_tensor", f"""{WITH_SESSIONS}, {BEHAVIOUR_SQL} SELECT b.seq, {SIZE} AS n_rows, 78 AS n_cols,
  CAST((SELECT sum(CAST(s.dest_port AS BIGINT)) FROM sessions s WHERE s.src_ip = b.src_ip AND s.session = b.session
    AND s.session_row BETWEEN b.session_row - {SIZE - 1} AND b.session_row) AS DOUBLE) AS port_sum,
  round(CAST(CAST(b.same_dst_port_ratio AS FLOAT) AS DOUBLE), 5) AS tail_ratio FROM behaviour b""")
def window_tensor_query(spark, sf_dir):
    rows = assemble(flow_features(prepared(spark, sf_dir)))
    df = window_tensor(rows, size=SIZE)
    w = F.col("window")
    port = F.aggregate(w, F.lit(0.0), lambda acc, r: acc + F.get(r, F.lit(18)).cast("double"))
    return df.select(
        "seq", F.size(w).alias("n_rows"), F.size(F.get(w, F.lit(0))).alias("n_cols"),
        port.alias("port_sum"),
        F.round(F.get(F.get(w, F.lit(0)), F.lit(75)).cast("double"), 5).alias("tail_ratio"),
    )
