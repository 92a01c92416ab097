"""Readers and writers, on files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timefmt import micros
from ..operators.features import flow_features
from ..operators.labeling import mixed_label
from ..session import scratch_path
from ..sources.eve import read_eve, read_flow_lines
from ..sources.labels import match_capture_dates, read_binetflow, read_label_csv
from ..sources.sinks import complete, write_by_label, write_scenarios
from .registry import EVE_SQL, eve, flows, query

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX"


def as_lines(df):
    """Event rows as JSON text, the way a sensor writes them; nulls are left out."""
    wanted = ["event_type", "flow_id", "src_ip", "src_port", "dest_ip", "dest_port", "proto",
              "app_proto", "timestamp", "flow", "tcp", "http", "tls", "dns"]
    return df.select(F.to_json(F.struct(*wanted), {"timestampFormat": ISO}).alias("value"))


def landed(spark, df, name):
    path = scratch_path(spark, name)
    as_lines(df).write.text(path)
    return path


@query("scan_eve", f"""WITH {EVE_SQL} SELECT kind AS event_type, count(*) AS n, CAST(sum(k) FILTER (kind = 'flow') AS BIGINT) AS k_sum,
  min(us) FILTER (kind = 'flow') AS first_us, max(us) FILTER (kind = 'flow') AS last_us, CAST(0 AS BIGINT) AS corrupt FROM eve GROUP BY kind
UNION ALL SELECT NULL, (SELECT count(*) FROM eve WHERE kind = 'tls'), NULL, NULL, NULL, (SELECT count(*) FROM eve WHERE kind = 'tls')""")
def scan_eve(spark, sf_dir):
    """Typed scan; one broken and one blank line follow every tls record."""
    events = eve(spark, sf_dir)
    path = scratch_path(spark, "eve")
    as_lines(events).write.text(path)
    broken = events.where(F.col("event_type") == "tls").select(
        F.explode(F.array(F.lit('{"event_type": "flow", '), F.lit(""))).alias("value")
    )
    broken.write.mode("append").text(path)
    read = read_eve(spark, path, keep_corrupt=True)
    return read.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("flow.bytes_toclient") / 37).cast("long")).alias("k_sum"),
        F.min(micros(F.col("flow.start"))).alias("first_us"),
        F.max(micros(F.col("flow.start"))).alias("last_us"),
        F.count_if("is_corrupt").alias("corrupt"),
    )


@query("scan_flow_lines", f"WITH {EVE_SQL} SELECT flow_id, src_ip, CAST(src_port AS INTEGER) AS src_port, us AS start_us FROM flows")
def scan_flow_lines(spark, sf_dir):
    read = read_flow_lines(spark, landed(spark, eve(spark, sf_dir), "lines"))
    return read.select("flow_id", "src_ip", "src_port", micros(F.col("flow.start")).alias("start_us"))


@query("scan_line_order", f"""WITH {EVE_SQL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM eve""")
def scan_line_order(spark, sf_dir):
    """Line positions follow the order in which each file was written."""
    from pyspark.sql import Window

    path = scratch_path(spark, "ordered")
    as_lines(eve(spark, sf_dir).sortWithinPartitions("seq")).write.text(path)
    read = read_eve(spark, path)
    w = Window.partitionBy("file").orderBy("seq")
    steps = read.withColumn("back", F.col("timestamp") < F.lag("timestamp").over(w))
    return steps.agg(F.count(F.lit(1)).alias("n"), F.count_if("back").alias("out_of_order"))


@query("label_fan_out", f"""WITH {EVE_SQL} SELECT CASE WHEN k % 3 = 0 THEN 'DoS' WHEN k % 3 = 1 THEN 'Bot' ELSE 'unmatched' END AS label,
  count(*) AS n FROM flows GROUP BY 1""")
def label_fan_out(spark, sf_dir):
    """Flows fanned out by label, then read back with the label of their folder."""
    path = scratch_path(spark, "fanout")
    third = F.pmod(F.col("k"), F.lit(3))
    rows = flows(spark, sf_dir).withColumn(
        "true_label", F.when(third == 0, "DoS").when(third == 1, "Bot")
    ).select("event_type", "src_ip", "dest_ip", "true_label")
    write_by_label(rows, path)
    return spark.read.json(path).groupBy(F.col("part").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_binetflow", f"""WITH {EVE_SQL} SELECT us - 7200000000 AS ts_us, lower(proto) AS proto, src_ip,
  CASE WHEN k % 5 = 0 THEN 0 ELSE CAST(src_port AS INTEGER) END AS src_port, dest_ip, CAST(dest_port AS INTEGER) AS dest_port,
  'flow=' || app AS label FROM flows WHERE k % 7 <> 0""")
def scan_binetflow(spark, sf_dir):
    """Argus lines with hexadecimal ports, bad times, comments and a header."""
    path = scratch_path(spark, "argus")
    none = F.lit("0")
    at = F.when(F.pmod(F.col("k"), F.lit(7)) == 0, "n/a").otherwise(
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS")
    )
    sport = F.when(F.pmod(F.col("k"), F.lit(5)) == 0, "0x0050").otherwise(F.col("src_port").cast("string"))
    lines = flows(spark, sf_dir).select(F.concat_ws(
        ",", at, none, "proto", "src_ip", sport, F.lit("->"), "dest_ip", F.col("dest_port").cast("string"),
        F.lit("CON"), none, none, none, none, none, F.concat(F.lit("flow="), F.col("app_proto")),
    ).alias("value"))
    head = "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label"
    extra = spark.createDataFrame([(head,), ("# comment",), ("short,row",), ("",)], "value string")
    lines.unionByName(extra).write.text(path)
    read = read_binetflow(spark, path, tz="+02:00")
    return read.select(micros(F.col("ts")).alias("ts_us"), "proto", "src_ip", "src_port", "dest_ip",
                       "dest_port", "label")


@query("scan_label_csv", f"""WITH {EVE_SQL} SELECT (us // 1000000) * 1000000 AS ts_us, proto, CAST(dest_port AS INTEGER) AS dest_port,
  CASE WHEN k % 3 = 0 THEN 'Benign' WHEN k % 3 = 1 THEN 'DoS' ELSE 'WebAttack' END AS label, src_ip, true AS full_key
FROM flows WHERE k % 11 <> 0""")
def scan_label_csv(spark, sf_dir):
    path = scratch_path(spark, "labels")
    third = F.pmod(F.col("k"), F.lit(3))
    port = F.when(F.pmod(F.col("k"), F.lit(11)) == 0, "none").otherwise(F.col("dest_port").cast("string"))
    flows(spark, sf_dir).select(
        port.alias("Destination Port"), F.when(F.col("proto") == "TCP", "6").otherwise("17").alias("Protocol"),
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("Timestamp"),
        F.when(third == 0, "BENIGN").when(third == 1, "DoS Hulk").otherwise("Web Attack - Brute").alias("Label"),
        F.col("src_ip").alias("Source IP"), F.col("src_port").alias("Source Port"),
        F.col("dest_ip").alias("Destination IP"),
    ).write.option("header", "true").csv(path)
    read, full = read_label_csv(spark, path)
    return read.select(micros(F.col("ts")).alias("ts_us"), "proto", "dest_port", "label", "src_ip",
                       F.lit(full).alias("full_key"))


@query("mixed_label_csv", f"""WITH {EVE_SQL} SELECT seq, true AS mixed, CASE k % 3 WHEN 0 THEN 'Benign' WHEN 1 THEN 'DoS' ELSE 'WebAttack' END AS label
FROM flows WHERE event_id % 6 = 0
UNION ALL SELECT f.seq, true, NULL FROM flows f WHERE f.event_id % 6 IN (2, 4) AND NOT EXISTS (
  SELECT 1 FROM flows l WHERE l.event_id % 2 = 1 AND l.dest_port = f.dest_port AND l.proto = f.proto)""")
def mixed_label_csv(spark, sf_dir):
    """Label files with endpoints beside files without: the former still label by the full key."""
    path = scratch_path(spark, "mixed-labels")
    rows = flows(spark, sf_dir).withColumn("src_port", F.col("seq").cast("int"))
    third = F.pmod(F.col("k"), F.lit(3))
    common = [
        F.col("dest_port").alias("Dst Port"), F.when(F.col("proto") == "TCP", "6").otherwise("17").alias("Protocol"),
        F.date_format(F.timestamp_micros(F.unix_micros("ts") + 3_600_000_000), "dd/MM/yyyy HH:mm:ss").alias("Timestamp"),
        F.when(third == 0, "BENIGN").when(third == 1, "DoS Hulk").otherwise("Web Attack - Brute").alias("Label"),
    ]
    ends = [F.col("src_ip").alias("Src IP"), F.col("src_port").alias("Src Port"), F.col("dest_ip").alias("Dst IP")]
    named = F.pmod("event_id", F.lit(6)) == 0
    rows.where(named).select(*ends, *common).write.option("header", "true").csv(f"{path}/full")
    rows.where(F.pmod("event_id", F.lit(2)) == 1).select(*common).write.option("header", "true").csv(f"{path}/bare")
    labels, full = read_label_csv(spark, [f"{path}/full", f"{path}/bare"])
    found = mixed_label(rows, labels).where(named | F.col("true_label").isNull())
    return found.select("seq", F.lit(not full).alias("mixed"), F.col("true_label").alias("label"))


@query("integer_flags", f"""WITH {EVE_SQL} SELECT flow_id, CAST(src_port AS INTEGER) AS src_port, """ + ", ".join(
    f"CASE WHEN (event_id % 64) & {mask} <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tcp_{name}"
    for name, mask in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32))) + " FROM flows")
def integer_flags(spark, sf_dir):
    """Flags sent as decimal numbers by some sensors and as hexadecimal texts by others."""
    rows = flows(spark, sf_dir)
    flags = F.pmod("event_id", F.lit(64))
    tcp = F.when(F.pmod("event_id", F.lit(2)) == 0, F.to_json(F.struct(flags.alias("tcp_flags_tc")))).otherwise(
        F.to_json(F.struct(F.lower(F.hex(flags)).alias("tcp_flags_tc"))))
    line = F.format_string(
        '{"event_type":"flow","flow_id":%d,"src_port":%d,"flow":{"age":1},"tcp":%s}', "flow_id", "src_port", tcp)
    path = scratch_path(spark, "flags")
    rows.select(line.alias("value")).write.text(path)
    feats = flow_features(read_eve(spark, path), "compact")
    return feats.select("flow_id", "src_port", *[f"feat.tcp_{n}" for n in ("fin", "syn", "rst", "psh", "ack", "urg")])


@query("scenario_manifest", f"""WITH {EVE_SQL} SELECT 's' || CAST(user_id % 4 AS VARCHAR) AS scenario, count(*) AS flows,
  CASE WHEN user_id % 4 < 2 THEN 1 ELSE 2 END AS run FROM flows GROUP BY 1, 3""")
def scenario_manifest(spark, sf_dir):
    """Two runs: the second one writes only the scenarios the first left out."""
    root, manifest = scratch_path(spark, "scenarios"), scratch_path(spark, "manifest")
    rows = flows(spark, sf_dir).select(
        "seq", F.concat(F.lit("s"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")).alias("scenario")
    )

    def run(df, number):
        complete(df.withColumn("run", F.lit(number)), manifest, lambda d: write_scenarios(d, root))

    run(rows.where(F.col("scenario").isin("s0", "s1")), 1)
    run(rows, 2)
    return spark.read.parquet(root).groupBy("scenario", "run").agg(F.count(F.lit(1)).alias("flows"))


@query("capture_dates", f"""WITH {EVE_SQL}, caps AS (SELECT 'S' || CAST(user_id % 9 AS VARCHAR) AS scenario,
  strftime(make_timestamp(CAST(arg_min(us, seq) AS BIGINT)), '%Y%m%d') AS day FROM flows GROUP BY 1),
lab AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN strftime(make_timestamp(CAST(us AS BIGINT)), '%Y%m%d') ELSE 'rest' END AS tag FROM eve WHERE kind = 'http'),
days AS (SELECT DISTINCT tag FROM lab)
SELECT scenario, count(*) AS label_rows FROM caps JOIN lab ON (tag = day) OR (day NOT IN (SELECT tag FROM days)) GROUP BY scenario""")
def capture_dates(spark, sf_dir):
    """Labels sit in dated files and one undated file."""
    rows = flows(spark, sf_dir).select(
        F.concat(F.lit("S"), F.pmod(F.col("user_id"), F.lit(9)).cast("string")).alias("scenario"), "ts", "seq"
    )
    labels = eve(spark, sf_dir).where(F.col("event_type") == "http").select(
        "seq", F.concat(F.lit("/labels/capture"), F.when(
            F.pmod(F.col("seq"), F.lit(2)) == 0, F.date_format("ts", "yyyyMMdd")
        ).otherwise("-rest"), F.lit(".binetflow")).alias("file"),
    )
    used = match_capture_dates(rows, labels)
    return used.groupBy("scenario").agg(F.count(F.lit(1)).alias("label_rows"))
