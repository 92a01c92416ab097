"""The stateful streams, run over the backlog and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timefmt import micros
from ..operators.features import ENRICHED, window_meta
from ..operators.windows import behaviour_of
from ..plans.events_eve import events_as_eve
from ..schema import WINDOW_FEATURES
from ..session import scratch_path
from ..sources.eve import stream_eve
from ..streaming.live import live_alerts, observe_progress
from ..streaming.progress import ProgressTotals
from ..streaming.state import KINDS, stream_enrich, stream_windows, with_arrival
from .alerts import SLOW_SQL, THRESHOLD, demo_score, demo_window_score
from .registry import ENRICHED_SQL, EVE_SQL, query, rounded, table
from .scans import as_lines
from .windows import BEHAVIOUR_SQL, GAP_S, ROUNDED_BEHAVIOUR, SIZE, WITH_SESSIONS

#: Longer than the table's time span, so that the batch queries agree.
KEEP_S = 40 * 86_400
DELAY = "40 days"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events_as_eve(raw)


def drain(df: DataFrame, name: str) -> DataFrame:
    """Run the stream over what is there and read its output."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    running = (
        df.writeStream.format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state").outputMode("append")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query("stream_enrich", f"WITH {ENRICHED_SQL} SELECT seq, hk * 10 AS http_length, tk IS NOT NULL AS has_tls, 'h' || CAST(dk % 20 AS VARCHAR) AS dns_name FROM enriched")
def stream_enrich_query(spark, sf_dir):
    out = stream_enrich(event_stream(spark, sf_dir), KEEP_S, delay=DELAY).select(
        "seq", F.col("enr_http.length").alias("http_length"),
        F.col("enr_tls").isNotNull().alias("has_tls"),
        F.get(F.col("enr_dns.queries"), F.lit(0))["rrname"].alias("dns_name"),
    )
    return drain(out, "stream-enrich")


@query("live_scan", f"""WITH {EVE_SQL} SELECT kind AS event_type, flow_id, us AS ts_us,
  CASE WHEN kind = 'flow' THEN '10.0.0.' || CAST(user_id % 250 AS VARCHAR) END AS src_ip FROM eve""")
def live_scan(spark, sf_dir):
    """JSON segments picked up by the live scan, four files a batch; malformed lines vanish."""
    path = scratch_path(spark, "segments")
    rows = events_as_eve(table(spark, sf_dir, "events"))
    torn = F.when(F.col("event_id") % 50 == 7, "{torn")
    as_lines(rows).write.text(path)
    rows.where(torn.isNotNull()).select(torn.alias("value")).write.mode("append").text(path)
    out = stream_eve(spark, path, max_files=4).select(
        "event_type", "flow_id", micros(F.col("timestamp")).alias("ts_us"),
        F.when(F.col("event_type") == "flow", F.col("src_ip")).alias("src_ip"))
    return drain(out, "live-scan")


@query("stream_windows",
       f"{WITH_SESSIONS}, {BEHAVIOUR_SQL} SELECT seq, src_ip, {ROUNDED_BEHAVIOUR} FROM behaviour")
def stream_windows_query(spark, sf_dir):
    flows = window_meta(stream_enrich(event_stream(spark, sf_dir), KEEP_S, delay=DELAY))
    framed = behaviour_of(stream_windows(flows, size=SIZE, gap_s=GAP_S))
    full = framed.where(F.col("window_rows") == SIZE)
    return drain(rounded(full.select("seq", "src_ip", *WINDOW_FEATURES)), "stream-windows")


@query("stream_tumbling", f"""{WITH_SESSIONS} SELECT src_ip, max(seq) AS last_seq, max(us) AS end_us
FROM sessions GROUP BY src_ip, session, (session_row - 1) // {SIZE} HAVING count(*) = {SIZE}""")
def stream_tumbling(spark, sf_dir):
    """Cleared after firing. A cleared source forgets when it was last seen."""
    flows = window_meta(stream_enrich(event_stream(spark, sf_dir), KEEP_S, delay=DELAY))
    framed = stream_windows(flows, size=SIZE, gap_s=GAP_S, fire="clear")
    full = framed.where(F.col("window_rows") == SIZE)
    return drain(full.select(
        "src_ip", F.col("seq").alias("last_seq"), micros(F.col("event_ts")).alias("end_us")
    ), "stream-tumbling")


@query("stream_alerts", f"""WITH {SLOW_SQL} SELECT us AS ts_us, src_ip, flow_id, label, confidence, stage,
  CAST(cls AS INTEGER) AS xgb_class, CAST(tb AS BIGINT) AS total_bytes FROM all_alerts""")
def stream_alerts(spark, sf_dir):
    alerts = live_alerts(
        event_stream(spark, sf_dir), demo_score, demo_window_score, THRESHOLD, size=SIZE,
        gap_s=GAP_S, timeout_s=KEEP_S, delay=DELAY,
    )
    ai = F.col("ai")
    return drain(alerts.select(
        micros(F.col("timestamp")).alias("ts_us"), "src_ip", "flow_id", ai["label"].alias("label"),
        ai["confidence"].alias("confidence"), ai["stage"].alias("stage"),
        ai["xgb_class"].alias("xgb_class"), ai["total_bytes"].alias("total_bytes"),
    ), "stream-alerts")


# Segments that arrive out of order ---------------------------------------------

def arriving(
    spark: SparkSession, sf_dir: str, segment: str, n: int, job: Callable[[DataFrame], DataFrame],
    name: str, hours: int = 1,
) -> tuple[DataFrame, ProgressTotals]:
    """Run ``job`` over the events as ``n`` segments, ``hours`` of arrival apart, each in a run of its own.

    ``segment`` is an expression that numbers the rows. The runs share a
    checkpoint, so state crosses both batches and restarts.
    """
    path = scratch_path(spark, name)
    rows = events_as_eve(table(spark, sf_dir, "events"))
    segment = F.expr(segment)
    since = F.lit(1_717_200_000_000_000) + segment * F.lit(hours * 3_600_000_000)
    rows = rows.withColumn("arrived", F.timestamp_micros(since.cast("long")))
    out, progress = None, ProgressTotals()
    for i in range(n):
        rows.where(segment == i).write.parquet(f"{path}/in/{i}")
        if out is None:
            source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true")
            out = job(source.parquet(f"{path}/in"))
        progress.follow(
            out.writeStream.format("parquet").option("path", f"{path}/out")
            .option("checkpointLocation", f"{path}/state").outputMode("append")
            .trigger(availableNow=True).start()
        )
    return spark.read.schema(out.schema).parquet(f"{path}/out"), progress


#: Within an id, the third and fourth row arrive after the fifth.
LATE_SEGMENT = "CASE event_id % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END"
LATE_SQL = EVE_SQL + """,
arrived AS (SELECT *, """ + LATE_SEGMENT + """ AS segment FROM eve),
placed AS (SELECT *, row_number() OVER (ORDER BY segment, us, seq) AS place,
  max(us) OVER (PARTITION BY flow_id ORDER BY segment, us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM arrived),
judged AS (SELECT *, flow_id <> 0 AND coalesce(us < clock - 300000000, false) AS late FROM placed),
turns AS (SELECT *, coalesce(sum(CASE WHEN kind = 'flow' THEN 1 ELSE 0 END) OVER (
    PARTITION BY flow_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn
  FROM judged WHERE NOT late AND flow_id <> 0),
attached AS (SELECT flow_id, turn, arg_min(k, place) FILTER (kind = 'http') AS hk, arg_min(k, place) FILTER (kind = 'tls') AS tk,
  arg_min(k, place) FILTER (kind = 'dns') AS dk FROM turns WHERE kind <> 'flow' GROUP BY flow_id, turn),
out_of_order AS (SELECT j.seq, a.hk, a.tk, a.dk, j.late FROM judged j LEFT JOIN turns t ON t.seq = j.seq
  LEFT JOIN attached a ON a.flow_id = t.flow_id AND a.turn = t.turn WHERE j.kind = 'flow')"""


def late_enrichment(source: DataFrame) -> DataFrame:
    return stream_enrich(observe_progress(source), KEEP_S, delay="300 seconds", arrival="arrived")


@query("stream_late_flows", f"""WITH {LATE_SQL} SELECT seq, hk * 10 AS http_length, tk IS NOT NULL AS has_tls,
  'h' || CAST(dk % 20 AS VARCHAR) AS dns_name, late FROM out_of_order""")
def stream_late_flows(spark, sf_dir):
    """Every flow once: in time and enriched, or late and bare."""
    out, _ = arriving(spark, sf_dir, LATE_SEGMENT, 3, lambda s: late_enrichment(s).select(
        "seq", F.col("enr_http.length").alias("http_length"), F.col("enr_tls").isNotNull().alias("has_tls"),
        F.get(F.col("enr_dns.queries"), F.lit(0))["rrname"].alias("dns_name"), "late",
    ), "stream-late")
    return out


@query("stream_progress", f"""WITH {LATE_SQL}, counters AS (
  SELECT 'progress.rows' AS counter, count(*) AS value FROM judged
  UNION ALL SELECT 'progress.flows', count(*) FROM judged WHERE kind = 'flow'
  UNION ALL SELECT 'progress.records', count(*) FROM judged WHERE kind <> 'flow'
  UNION ALL SELECT 'enrichment.late_flows', count(*) FROM judged WHERE late AND kind = 'flow'
  UNION ALL SELECT 'enrichment.late_records', count(*) FROM judged WHERE late AND kind <> 'flow'
  UNION ALL SELECT 'enrichment.evicted', 0 UNION ALL SELECT 'input_rows', count(*) FROM judged)
SELECT counter, value::BIGINT AS value FROM counters""")
def stream_progress(spark, sf_dir):
    """The counters of a query over three runs."""
    _, progress = arriving(spark, sf_dir, LATE_SEGMENT, 3, lambda s: late_enrichment(s).select("seq"), "stream-progress")
    return progress.table(spark).where(~F.col("counter").isin("batches", "busy_ms"))


@query("stream_late_alerts", f"""WITH {LATE_SQL},
scored_late AS (SELECT f.seq, o.late,
  0.4::DOUBLE * (CASE WHEN f.dest_port < 1024 THEN 1 ELSE 0 END) + 0.5::DOUBLE * (CASE WHEN o.hk IS NOT NULL THEN 1 ELSE 0 END) + 0.05::DOUBLE AS w
  FROM out_of_order o JOIN flows f ON f.seq = o.seq)
SELECT seq, late, round(w, 4) AS confidence, CASE WHEN w >= 0.9 THEN 'record' ELSE 'port' END AS why FROM scored_late WHERE w >= 0.4""")
def stream_late_alerts(spark, sf_dir):
    """Late flows reach the flow model like all others."""
    w = 0.4 * (F.col("dest_port") < 1024).cast("double") + 0.5 * F.col("enr_http").isNotNull().cast("double") + 0.05
    out, _ = arriving(spark, sf_dir, LATE_SEGMENT, 3, lambda s: late_enrichment(s).withColumn("w", w).where("w >= 0.4").select(
        "seq", "late", F.round("w", 4).alias("confidence"), F.when(F.col("w") >= 0.9, "record").otherwise("port").alias("why"),
    ), "stream-late-alerts")
    return out


#: Two successive segments for each third of the sources, odd rows after even ones.
VISIT = "user_id % 250 % 3 + event_id % 2"
VISIT_SQL = EVE_SQL + f""",
visits AS (SELECT seq, src_ip, us, {VISIT} AS segment FROM flows),
timed AS (SELECT *, coalesce(us < max(us) OVER (PARTITION BY src_ip ORDER BY segment, us, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000000, false) AS late FROM visits),
opened AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY segment, us, seq) > {GAP_S * 1_000_000} THEN 1 ELSE 0 END AS opens
  FROM timed WHERE NOT late),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY src_ip ORDER BY segment, us, seq) AS run FROM opened),
rows_in AS (SELECT *, least(row_number() OVER (PARTITION BY src_ip, run ORDER BY segment, us, seq), {SIZE}) AS filled FROM runs)"""


def bare(events: DataFrame) -> DataFrame:
    """Flows with nothing attached."""
    return events.where("event_type = 'flow'").withColumns({
        c: F.lit(None).cast(KINDS[k]) for k, c in ENRICHED.items()
    })


@query("stream_evictions", f"""WITH {VISIT_SQL}
SELECT 'late' AS note, 0 AS window_rows, count(*) AS n FROM timed WHERE late HAVING count(*) > 0
UNION ALL SELECT 'evicted', 0, count(*) FROM (SELECT src_ip FROM visits GROUP BY src_ip HAVING max(segment) < 3) HAVING count(*) > 0
UNION ALL SELECT NULL, filled::INTEGER, count(*) FROM rows_in GROUP BY filled""")
def stream_evictions(spark, sf_dir):
    """Buffers over four arrivals: late rows skip them, sources that stay away are forgotten by timers."""
    out, _ = arriving(spark, sf_dir, VISIT, 4, lambda s: stream_windows(
        window_meta(with_arrival(bare(s), "arrived")).withColumn("event_ts", F.col("ts")),
        size=SIZE, gap_s=GAP_S, delay="1 day", partial=False, with_notes=True,
    ).select("note", "window_rows"), "stream-evictions", hours=72)
    return out.groupBy("note", "window_rows").agg(F.count("*").alias("n"))
