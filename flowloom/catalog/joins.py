"""Labelling joins and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import MALWARE_TERMS
from ..functions.timefmt import micros
from ..operators.labeling import (
    FIVE_TUPLE, apply_offset, class_names, clock_offset, default_label, five_tuple_key,
    folded_label, interval_label, merged_spans, nearest_label, rule_label, unmatched,
)
from ..operators.metrics import compare_counts, relabel_report
from ..schema import FLOW_CLASSES
from .registry import EVE_SQL, eve, flows, query, table

TOLERANCE_S = 21_600


def marks(spark, sf_dir):
    """The non-flow events as a label table."""
    raw = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "view", "click"))
    return raw.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"),
        F.col("event_id").alias("seq"),
    )


def raw_flows(spark, sf_dir):
    return flows(spark, sf_dir).select(
        "seq", "event_id", "user_id", "ts", "k", "src_ip", "src_port", "dest_ip", "dest_port", "proto"
    )


MARKS_SQL = """marks AS (SELECT event_id AS seq, user_id, epoch_us(ts) AS us, event_type AS label
  FROM events WHERE event_type IN ('signup', 'view', 'click'))"""
NEAREST_SQL = f"""{EVE_SQL}, {MARKS_SQL}, best AS (
  SELECT f.seq, arg_min(m.label, abs(f.us - m.us) * 100000000::HUGEINT + m.seq) AS gt_label,
    min(abs(f.us - m.us)) AS gap
  FROM flows f JOIN marks m ON m.user_id = f.user_id AND abs(f.us - m.us) <= {TOLERANCE_S * 1_000_000}
  GROUP BY f.seq)"""


def nearest(spark, sf_dir):
    return nearest_label(
        raw_flows(spark, sf_dir), marks(spark, sf_dir), ["user_id"],
        tolerance_s=TOLERANCE_S, diff="gap_s",
    )


@query("nearest_label", f"""WITH {NEAREST_SQL} SELECT f.seq, b.gt_label, b.gap AS gap_us
FROM flows f LEFT JOIN best b ON b.seq = f.seq""")
def nearest_label_query(spark, sf_dir):
    return nearest(spark, sf_dir).select(
        "seq", "gt_label", F.round(F.col("gap_s") * 1e6).cast("long").alias("gap_us")
    )


SWAPPED_SQL = """swapped AS (
  SELECT seq, us + (CASE WHEN k % 2 = 0 THEN 2000000 ELSE 9000000 END) AS us, 'L' || CAST(k % 5 AS VARCHAR) AS label,
    CASE WHEN event_id % 2 = 1 THEN dest_ip ELSE src_ip END AS src_ip,
    CASE WHEN event_id % 2 = 1 THEN dest_port ELSE src_port END AS src_port,
    CASE WHEN event_id % 2 = 1 THEN src_ip ELSE dest_ip END AS dest_ip,
    CASE WHEN event_id % 2 = 1 THEN src_port ELSE dest_port END AS dest_port, lower(proto) AS proto
  FROM flows)"""


def swapped(spark, sf_dir):
    """The flows as labels: endpoints swapped on odd ids, clock 2 s or 9 s late."""
    odd = F.pmod(F.col("event_id"), F.lit(2)) == 1

    def side(a: str, b: str):
        return F.when(odd, F.col(a)).otherwise(F.col(b))

    late = F.when(F.pmod(F.col("k"), F.lit(2)) == 0, 2_000_000).otherwise(9_000_000)
    return raw_flows(spark, sf_dir).select(
        "seq", F.timestamp_micros(micros(F.col("ts")) + late).alias("ts"),
        F.concat(F.lit("L"), F.pmod(F.col("k"), F.lit(5)).cast("string")).alias("label"),
        side("dest_ip", "src_ip").alias("src_ip"), side("dest_port", "src_port").alias("src_port"),
        side("src_ip", "dest_ip").alias("dest_ip"), side("src_port", "dest_port").alias("dest_port"),
        F.lower("proto").alias("proto"),
    )


@query("five_tuple_key", f"""WITH {EVE_SQL}, {SWAPPED_SQL}, sides AS (
  SELECT 'flow' AS side, seq, src_ip, src_port, dest_ip, dest_port, lower(proto) AS proto FROM flows
  UNION ALL SELECT 'label', seq, src_ip, src_port, dest_ip, dest_port, proto FROM swapped)
SELECT side, seq, proto AS proto_key,
  CASE WHEN src_ip < dest_ip OR (src_ip = dest_ip AND src_port <= dest_port) THEN src_ip || ':' || CAST(src_port AS VARCHAR)
    ELSE dest_ip || ':' || CAST(dest_port AS VARCHAR) END AS low,
  CASE WHEN src_ip < dest_ip OR (src_ip = dest_ip AND src_port <= dest_port) THEN dest_ip || ':' || CAST(dest_port AS VARCHAR)
    ELSE src_ip || ':' || CAST(src_port AS VARCHAR) END AS high FROM sides""")
def five_tuple_query(spark, sf_dir):
    def keyed(df, side):
        text = {n: F.concat_ws(":", F.col(f"{c}.ip"), F.col(f"{c}.port").cast("string"))
                for n, c in (("low", "ep_low"), ("high", "ep_high"))}
        return five_tuple_key(df).select(
            F.lit(side).alias("side"), "seq", "proto_key", *[c.alias(n) for n, c in text.items()]
        )

    return keyed(raw_flows(spark, sf_dir), "flow").unionByName(keyed(swapped(spark, sf_dir), "label"))


@query("nearest_label_five_tuple", f"""WITH {EVE_SQL}, {SWAPPED_SQL}, hit AS (
  SELECT f.seq, arg_min(s.label, abs(f.us - s.us) * 100000000::HUGEINT + s.seq) AS gt_label
  FROM flows f JOIN swapped s ON abs(f.us - s.us) <= 5000000 AND lower(f.proto) = s.proto AND (
    (f.src_ip = s.src_ip AND f.src_port = s.src_port AND f.dest_ip = s.dest_ip AND f.dest_port = s.dest_port)
    OR (f.src_ip = s.dest_ip AND f.src_port = s.dest_port AND f.dest_ip = s.src_ip AND f.dest_port = s.src_port))
  GROUP BY f.seq)
SELECT f.seq, h.gt_label FROM flows f LEFT JOIN hit h ON h.seq = f.seq""")
def nearest_five_tuple(spark, sf_dir):
    found = nearest_label(
        five_tuple_key(raw_flows(spark, sf_dir)), five_tuple_key(swapped(spark, sf_dir)), FIVE_TUPLE
    )
    return found.select("seq", "gt_label")


def _folded_sql(on: str, cols: str) -> str:
    return f"""WITH {EVE_SQL}, {MARKS_SQL}, keyed AS (
  SELECT e.seq, e.us, m.label, {cols} FROM marks m JOIN eve e ON e.seq = m.seq),
pairs AS (
  SELECT f.seq, m.label, m.seq AS mseq, abs(f.us - m.us) % 3600000000 AS r
  FROM flows f JOIN keyed m ON {on}),
chosen AS (
  SELECT seq, arg_min(label, least(r, 3600000000 - r) * 100000000::HUGEINT + mseq)
      FILTER (least(r, 3600000000 - r) <= 120000000) AS near, arg_min(label, mseq) AS first_label
  FROM pairs GROUP BY seq)
SELECT f.seq, coalesce(c.near, c.first_label) AS true_label FROM flows f LEFT JOIN chosen c ON c.seq = f.seq"""


@query("folded_time_label", _folded_sql("f.user_id = m.user_id", "e.user_id"))
def folded_time_label(spark, sf_dir):
    return folded_label(raw_flows(spark, sf_dir), marks(spark, sf_dir), ["user_id"]).select(
        "seq", "true_label"
    )


def service_marks(spark, sf_dir):
    """Labels that know the service only: destination port and protocol."""
    return eve(spark, sf_dir).where(F.col("event_type") != "flow").select(
        "dest_port", "proto", "ts",
        F.coalesce(F.when(F.col("event_type") == "http", "signup"),
                   F.when(F.col("event_type") == "dns", "view"), F.lit("click")).alias("label"),
        "seq",
    )


@query("degraded_key_label", _folded_sql(
    "f.dest_port = m.dp AND f.proto = m.pr",
    """CASE e.k % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 8080 ELSE 50000 END AS dp,
    CASE WHEN e.event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS pr"""))
def degraded_key_label(spark, sf_dir):
    return folded_label(
        raw_flows(spark, sf_dir), service_marks(spark, sf_dir), ["dest_port", "proto"]
    ).select("seq", "true_label")


@query("unmatched_flows", f"""WITH {EVE_SQL}, pairs AS (
  SELECT DISTINCT '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS src_ip, '192.168.0.' || CAST(k % 16 AS VARCHAR) AS dest_ip
  FROM eve WHERE kind = 'http')
SELECT f.seq, f.src_ip, f.dest_ip FROM flows f ANTI JOIN pairs p ON p.src_ip = f.src_ip AND p.dest_ip = f.dest_ip""")
def unmatched_flows(spark, sf_dir):
    truth = eve(spark, sf_dir).where(F.col("event_type") == "http").select(
        "src_ip", "dest_ip", "ts", F.col("event_type").alias("label"), "seq"
    )
    found = folded_label(raw_flows(spark, sf_dir), truth, ["src_ip", "dest_ip"])
    return unmatched(found).select("seq", "src_ip", "dest_ip")


def _late_copies(spark, sf_dir):
    """Flows and, two hours earlier, the same flows as labels; two key choices."""
    base = raw_flows(spark, sf_dir).select("seq", "ts", "event_id", "user_id")

    def choice(df, name, key):
        return df.select("seq", "ts", F.lit(name).alias("scenario"), F.col(key).alias("key"))

    both = choice(base, "unique", "event_id").unionByName(choice(base, "repeated", "user_id"))
    early = F.timestamp_micros(micros(F.col("ts")) - 7_200_000_000)
    return both, both.withColumn("ts", early).withColumn("label", F.col("key").cast("string"))


OFFSETS_SQL = f"""{EVE_SQL}, sides AS (
  SELECT 'unique' AS scenario, event_id AS key, us, seq FROM flows
  UNION ALL SELECT 'repeated', user_id, us, seq FROM flows),
diffs AS (
  SELECT f.scenario, CAST(f.us - (l.us - 7200000000) AS DOUBLE) AS d
  FROM sides f JOIN sides l ON l.scenario = f.scenario AND l.key = f.key
  WHERE abs(f.us - (l.us - 7200000000)) < 604800000000),
span AS (
  SELECT scenario, min(d) - (CASE WHEN min(d) = max(d) THEN 500000 ELSE 0 END) AS a,
    max(d) + (CASE WHEN min(d) = max(d) THEN 500000 ELSE 0 END) AS b FROM diffs GROUP BY scenario),
binned AS (
  SELECT d.scenario, s.a, s.b, i.i, count(*) AS n FROM diffs d JOIN span s ON s.scenario = d.scenario
  JOIN range(100) AS i(i) ON d.d >= s.a + (s.b - s.a) * i.i / 100
    AND (d.d < s.a + (s.b - s.a) * (i.i + 1) / 100 OR i.i = 99) GROUP BY ALL),
modal AS (
  SELECT scenario, arg_max(a + (b - a) / 100 * (i + 0.5), n * 1000 - i) / 1e6 AS c, sum(n) AS pairs
  FROM binned GROUP BY scenario),
offsets AS (
  SELECT scenario, CAST(pairs AS BIGINT) AS pairs,
    CASE WHEN abs(c - round(c / 3600) * 3600) < 10 THEN round(c / 3600) * 3600 ELSE c END AS offset_s FROM modal)"""


@query("clock_offset", f"WITH {OFFSETS_SQL} SELECT scenario, pairs, round(offset_s, 3) AS offset_s FROM offsets")
def clock_offset_query(spark, sf_dir):
    side, labels = _late_copies(spark, sf_dir)
    return clock_offset(side, labels, ["key"]).select(
        "scenario", "pairs", F.round("offset_s", 3).alias("offset_s")
    )


@query("clock_aligned_label", f"""WITH {EVE_SQL} SELECT seq, CAST(event_id AS VARCHAR) AS gt_label,
  us - 7200000000 AS aligned_us FROM flows""")
def clock_aligned_label(spark, sf_dir):
    side, labels = _late_copies(spark, sf_dir)
    unique = side.where(F.col("scenario") == "unique")
    truth = labels.where(F.col("scenario") == "unique")
    moved = apply_offset(unique, clock_offset(unique, truth, ["key"]))
    found = nearest_label(moved, truth, ["scenario", "key"], flow_ts="ts_aligned")
    return found.select("seq", "gt_label", micros(F.col("ts_aligned")).alias("aligned_us"))


@query("default_label", f"""WITH {NEAREST_SQL}, s AS (
  SELECT f.seq, f.us // 86400000000 AS scenario, b.gt_label FROM flows f LEFT JOIN best b ON b.seq = f.seq),
known AS (SELECT DISTINCT epoch_us(ts) // 86400000000 AS scenario FROM events WHERE event_type = 'signup' AND value > 150)
SELECT s.seq, s.scenario, CASE WHEN k.scenario IS NULL THEN 'Botnet' ELSE s.gt_label END AS gt_label
FROM s LEFT JOIN known k ON k.scenario = s.scenario""")
def default_label_query(spark, sf_dir):
    """Each day is a scenario; only days with a costly signup have ground truth."""
    day = F.floor(micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    truth = table(spark, sf_dir, "events").where(
        (F.col("event_type") == "signup") & (F.col("value") > 150)
    ).select(day.alias("scenario"))
    labelled = nearest(spark, sf_dir).withColumn("scenario", day)
    return default_label(labelled, truth).select("seq", "scenario", "gt_label")


@query("scenario_report", f"""WITH {NEAREST_SQL}, s AS (
  SELECT 'S' || CAST(f.user_id % 9 AS VARCHAR) AS scenario,
    CASE b.gt_label WHEN 'signup' THEN 'From-Botnet' WHEN 'view' THEN 'From-Normal' WHEN 'click' THEN 'Background' END AS l
  FROM flows f LEFT JOIN best b ON b.seq = f.seq)
SELECT scenario, count(*) AS flows, count(l) AS matched,
  count(*) FILTER (l = 'From-Botnet') AS botnet, count(*) FILTER (l = 'From-Normal') AS normal,
  count(*) FILTER (l = 'Background') AS background, count(*) FILTER (l IS NULL) AS unmatched,
  round(count(l) * 100.0 / count(*), 4) AS match_pct FROM s GROUP BY ROLLUP (scenario)""")
def scenario_report(spark, sf_dir):
    name = F.create_map(*[F.lit(x) for x in (
        "signup", "From-Botnet", "view", "From-Normal", "click", "Background")])
    df = nearest(spark, sf_dir).withColumns({
        "scenario": F.concat(F.lit("S"), F.pmod(F.col("user_id"), F.lit(9)).cast("string")),
        "gt_label": F.try_element_at(name, F.col("gt_label")),
    })
    return relabel_report(df, terms=MALWARE_TERMS).withColumn("match_pct", F.round("match_pct", 4))


RULES = dict(
    attackers=("10.0.0.1", "10.0.0.2", "192.168.0.3"), external="192.168.0.3",
    bot_victims=("10.0.0.5", "192.168.0.7"), servers=("192.168.0.1", "192.168.0.2"),
    flooded="192.168.0.1",
)


def _in(col: str, values) -> str:
    return f"{col} IN ({', '.join(repr(v) for v in values)})"


def _between(one, other) -> str:
    return (f"(({_in('src_ip', one)} AND {_in('dest_ip', other)}) OR "
            f"({_in('dest_ip', one)} AND {_in('src_ip', other)}))")


_TOUCH = f"({_in('src_ip', RULES['attackers'])} OR {_in('dest_ip', RULES['attackers'])})"


@query("rule_label", f"""WITH {EVE_SQL}, m AS (SELECT *, (us // 60000000) % 1440 AS minute FROM flows)
SELECT seq, CASE
  WHEN {_between(RULES['attackers'], RULES['servers'])} THEN 'DDoS'
  WHEN dest_ip = '192.168.0.1' AND proto = 'TCP' AND minute BETWEEN 1130 AND 1180 THEN 'DDoS'
  WHEN {_TOUCH} AND minute BETWEEN 1010 AND 1120 THEN 'PortScan'
  WHEN {_TOUCH} AND minute BETWEEN 780 AND 855 THEN 'Bot'
  WHEN {_between(RULES['bot_victims'], RULES['attackers'])} THEN 'Bot'
  WHEN src_ip = '192.168.0.3' OR dest_ip = '192.168.0.3' THEN
    CASE WHEN minute BETWEEN 1010 AND 1120 THEN 'PortScan' ELSE 'DDoS' END
  ELSE 'Benign' END AS gt_label FROM m""")
def rule_label_query(spark, sf_dir):
    return rule_label(raw_flows(spark, sf_dir), **RULES).select("seq", "gt_label")


@query("interval_label", f"""WITH {EVE_SQL},
w AS (SELECT min(us) AS a, max(us) AS b FROM flows WHERE value > 60 GROUP BY us // 86400000000),
v AS (SELECT DISTINCT dest_ip AS ip FROM flows WHERE value > 250)
SELECT seq, CASE WHEN EXISTS (SELECT 1 FROM w WHERE us BETWEEN a AND b)
  AND (src_ip IN (SELECT ip FROM v) OR dest_ip IN (SELECT ip FROM v)) THEN 1 ELSE 0 END AS label FROM flows""")
def interval_label_query(spark, sf_dir):
    """One attack window per day, between its costly events; their targets are the victims."""
    base = flows(spark, sf_dir)
    windows = base.where(F.col("value") > 60).groupBy(F.to_date("ts")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end")
    )
    victims = base.where(F.col("value") > 250).select(F.col("dest_ip").alias("ip"))
    return interval_label(raw_flows(spark, sf_dir), windows, victims).select("seq", "label")


#: A window per record, up to 100 minutes long: most of them overlap.
MANY_WINDOWS_SQL = EVE_SQL + """,
w AS (SELECT us AS a, us + k * 60000000 AS b FROM eve WHERE kind IN ('dns', 'tls')),
v AS (SELECT DISTINCT dest_ip AS ip FROM flows WHERE k % 16 < 12)"""


def many_windows(spark, sf_dir):
    records = eve(spark, sf_dir).where(F.col("event_type").isin("dns", "tls"))
    end = F.timestamp_micros(F.unix_micros("ts") + F.col("k").cast("long") * 60_000_000)
    return records.select(F.col("ts").alias("start"), end.alias("end"))


@query("merged_spans", f"""WITH {MANY_WINDOWS_SQL},
reach AS (SELECT a, b, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM w),
numbered AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far + 1 THEN 1 ELSE 0 END) OVER (ORDER BY a, b) AS span FROM reach)
SELECT min(a) AS a, max(b) AS b FROM numbered GROUP BY span""")
def merged_spans_query(spark, sf_dir):
    return merged_spans(many_windows(spark, sf_dir))


@query("overlapping_interval_label", f"""WITH {MANY_WINDOWS_SQL}
SELECT seq, CASE WHEN (src_ip IN (SELECT ip FROM v) OR dest_ip IN (SELECT ip FROM v))
  AND EXISTS (SELECT 1 FROM w WHERE f.us >= w.a AND f.us <= w.b) THEN 1 ELSE 0 END AS label FROM flows f""")
def overlapping_interval_label(spark, sf_dir):
    """As many windows as records, few of them alone."""
    victims = flows(spark, sf_dir).where(F.col("k") % 16 < 12).select(F.col("dest_ip").alias("ip"))
    return interval_label(raw_flows(spark, sf_dir), many_windows(spark, sf_dir), victims).select("seq", "label")


@query("class_lookup", f"""WITH {EVE_SQL} SELECT seq, CASE k % 8 WHEN 0 THEN 'Benign' WHEN 1 THEN 'DoS'
  WHEN 2 THEN 'DDoS' WHEN 3 THEN 'WebAttack' WHEN 4 THEN 'Infiltration' WHEN 5 THEN 'Bot' ELSE 'Unknown' END AS class_name
FROM flows""")
def class_lookup(spark, sf_dir):
    df = raw_flows(spark, sf_dir).withColumn("class_id", F.pmod(F.col("k"), F.lit(8)).cast("int"))
    return class_names(df, FLOW_CLASSES).select("seq", "class_name")


@query("ab_counts", f"""WITH {NEAREST_SQL}, folded AS (SELECT label, count(*) AS n FROM marks GROUP BY label),
near AS (SELECT coalesce(b.gt_label, 'none') AS label, count(*) AS n FROM flows f LEFT JOIN best b ON b.seq = f.seq GROUP BY 1)
SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after,
  coalesce(b.n, 0) - coalesce(a.n, 0) AS difference FROM near a FULL JOIN folded b ON b.label = a.label""")
def ab_counts(spark, sf_dir):
    near = nearest(spark, sf_dir).select(F.coalesce("gt_label", F.lit("none")).alias("label"))
    return compare_counts(near, marks(spark, sf_dir).select("label"))
