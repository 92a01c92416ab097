"""Feature projections and label normalising."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coerce import clean_non_finite, finite
from ..functions.labels import (
    MALWARE_TERMS, attack_family, mentions, protocol, remap, traffic_kind,
)
from ..functions.timefmt import ARGUS_FORMATS, ISO, LABEL_CSV_FORMATS, micros, parse_ts
from ..operators.features import (
    assemble, flow_features, flow_meta, no_enrichment, window_meta,
)
from ..operators.labeling import class_names, coarse_classes, drop_infrastructure_noise
from ..schema import BASE_FEATURES, COMPACT_FEATURES, ENRICHED_FEATURES, FLOW_CLASSES
from .registry import (
    ENRICHED_SQL, EVE_SQL, enriched, eve, flag_sql, flows, query, rounded,
)

APPS = ("http", "dns", "tls", "dcerpc", "smb", "rdp", "failed")

BASE_SQL = {
    "duration_s": "dur", "pkts_toserver": "pts", "pkts_toclient": "ptc",
    "bytes_toserver": "bts", "bytes_toclient": "btc",
    "total_pkts": "tp", "total_bytes": "tb",
    "pkt_rate": "tp / greatest(dur, 0.1)", "byte_rate": "tb / greatest(dur, 0.1)",
    "bytes_per_pkt": "tb / greatest(tp, 1)",
    "upload_byte_ratio": "bts / greatest(tb, 1)", "upload_pkt_ratio": "pts / greatest(tp, 1)",
    "byte_asymmetry": "abs(bts - btc) / greatest(tb, 1)",
    "download_byte_ratio": "btc / greatest(tb, 1)",
    "download_pkt_ratio": "ptc / greatest(tp, 1)",
    "flow_age": "dur", "is_unidirectional": flag_sql("ptc = 0"),
    "pkt_size_variance_proxy": "abs(bts / greatest(pts, 1) - btc / greatest(ptc, 1))",
    "dest_port": "dest_port", "src_port": "src_port",
    "is_well_known_port": flag_sql("dest_port < 1024"),
    "is_registered_port": flag_sql("dest_port >= 1024 AND dest_port < 49152"),
    "is_high_port": flag_sql("dest_port >= 49152"),
    "is_same_port": flag_sql("src_port = dest_port"),
    "is_ipv6": "0.0", "is_tcp": flag_sql("proto = 'TCP'"), "is_udp": flag_sql("proto = 'UDP'"),
    "is_icmp": "0.0",
    **{f"app_{a}": flag_sql(f"app = '{a}'") for a in APPS},
    "app_unknown": flag_sql(f"app NOT IN {APPS}"),
    "state_established": flag_sql("k3 = 0"), "state_closed": flag_sql("k3 = 1"),
    "state_new": flag_sql("k3 = 2"),
    "reason_timeout": flag_sql("k3 = 0"), "reason_rst": flag_sql("k3 = 1"),
    "reason_fin": flag_sql("k3 = 2"),
}
BITS = "(event_id % 32)"
METHOD = "(hk % 4)"
STATUS = "(hk % 5)"
ENRICHED_COLUMNS = {
    "tcp_syn": flag_sql(f"({BITS} & 2) > 0"), "tcp_ack": flag_sql(f"({BITS} & 16) > 0"),
    "tcp_fin": flag_sql(f"({BITS} & 1) > 0"), "tcp_rst": flag_sql(f"({BITS} & 4) > 0"),
    "tcp_psh": flag_sql(f"({BITS} & 8) > 0"),
    "http_method_get": flag_sql(f"{METHOD} = 0"), "http_method_post": flag_sql(f"{METHOD} = 1"),
    "http_method_head": flag_sql(f"{METHOD} = 2"), "http_method_other": flag_sql(f"{METHOD} = 3"),
    "http_status_2xx": flag_sql(f"{STATUS} = 0"), "http_status_3xx": flag_sql(f"{STATUS} = 1"),
    "http_status_4xx": flag_sql(f"{STATUS} = 2"), "http_status_5xx": flag_sql(f"{STATUS} >= 3"),
    "http_content_type_html": flag_sql(f"{STATUS} = 0"),
    "http_content_type_octet": flag_sql(f"{STATUS} = 1"),
    "http_content_type_json": flag_sql(f"{STATUS} = 2"),
    "http_content_type_other": flag_sql(f"{STATUS} = 3"),
    "tls_exists": flag_sql("tk IS NOT NULL"), "tls_sni_exists": flag_sql("tk % 8 <> 0"),
    "dns_exists": flag_sql("dk IS NOT NULL"),
    "dns_query_a": flag_sql("dk % 4 = 0"), "dns_query_aaaa": flag_sql("dk % 4 = 1"),
    "dns_query_mx": flag_sql("dk % 4 = 2"), "dns_query_other": flag_sql("dk % 4 = 3"),
    "dns_rcode_noerror": flag_sql("dk % 5 = 0"), "dns_rcode_nxdomain": flag_sql("dk % 5 = 1"),
    "dns_rcode_refused": flag_sql("dk % 5 = 2"), "dns_rcode_other": flag_sql("dk % 5 = 3"),
}
TRAIN_COLUMNS = {
    **{f"tcp_{f}": "0.0" for f in ("syn", "ack", "fin", "rst", "psh")},
    **{c: s for c, s in ENRICHED_COLUMNS.items() if not c.startswith("tcp_")},
    "http_status_5xx": flag_sql(f"{STATUS} = 3"),
    # Only the bare words are excluded, so every full media type counts as other.
    "http_content_type_other": flag_sql(f"{STATUS} < 4"),
}
TC = "(event_id % 64)"
EPS = "1e-6::DOUBLE"
PORTS = "(80, 443, 53, 22, 21, 25, 110, 143, 3389, 8080)"
COMPACT_SQL = {
    **{c: BASE_SQL[c] for c in (
        "src_port", "dest_port", "is_tcp", "is_udp", "is_icmp", "flow_age", "pkts_toserver",
        "pkts_toclient", "bytes_toserver", "bytes_toclient", "total_pkts", "total_bytes",
        "state_new", "state_established", "state_closed")},
    "pkt_rate": f"tp / (dur + {EPS})", "byte_rate": f"tb / (dur + {EPS})",
    "avg_pkt_size": f"tb / (tp + {EPS})", "mean_pkt_size": f"tb / (tp + {EPS})",
    "bytes_per_pkt_s2c": f"btc / (ptc + {EPS})", "bytes_per_pkt_c2s": f"bts / (pts + {EPS})",
    "pkt_ratio": f"pts / (ptc + {EPS})", "byte_ratio": f"bts / (btc + {EPS})",
    "tcp_fin": flag_sql(f"({TC} & 1) > 0"), "tcp_syn": flag_sql(f"({TC} & 2) > 0"),
    "tcp_rst": flag_sql(f"({TC} & 4) > 0"), "tcp_psh": flag_sql(f"({TC} & 8) > 0"),
    "tcp_ack": flag_sql(f"({TC} & 16) > 0"), "tcp_urg": flag_sql(f"({TC} & 32) > 0"),
    "has_http": "0.0", "http_length": "0.0", "http_status": "0.0", "has_tls": "0.0",
    "has_dns": "0.0",
    "src_port_well_known": flag_sql(f"src_port IN {PORTS}"),
    "dest_port_well_known": flag_sql(f"dest_port IN {PORTS}"),
}


def _projection(names, exprs, digits=6) -> str:
    return ", ".join(f'round(CAST({exprs[n]} AS DOUBLE), {digits}) AS "{n}"' for n in names)


@query("flow_features", f"WITH {EVE_SQL} SELECT seq, {_projection(BASE_FEATURES, BASE_SQL)} FROM flows")
def flow_features_query(spark, sf_dir):
    df = flow_features(flows(spark, sf_dir), "base42")
    return rounded(df.select("seq", "feat.*"))


@query("tcp_flag_bits", f"WITH {EVE_SQL} SELECT seq, {_projection(ENRICHED_FEATURES[:5], ENRICHED_COLUMNS)} FROM flows")
def tcp_flag_bits(spark, sf_dir):
    df = flow_features(no_enrichment(flows(spark, sf_dir)))
    return df.select("seq", *[f"feat.{c}" for c in ENRICHED_FEATURES[:5]])


@query("enriched_features",
       f"WITH {ENRICHED_SQL} SELECT seq, {_projection(ENRICHED_FEATURES, ENRICHED_COLUMNS)} FROM enriched")
def enriched_features(spark, sf_dir):
    df = flow_features(enriched(spark, sf_dir))
    return df.select("seq", *[f"feat.{c}" for c in ENRICHED_FEATURES])


@query("train_profile_features",
       f"WITH {ENRICHED_SQL} SELECT seq, {_projection(ENRICHED_FEATURES, TRAIN_COLUMNS)} FROM enriched")
def train_profile(spark, sf_dir):
    df = flow_features(enriched(spark, sf_dir), "train")
    return df.select("seq", *[f"feat.{c}" for c in ENRICHED_FEATURES])


@query("compact_features",
       f"WITH {EVE_SQL} SELECT seq, {_projection(COMPACT_FEATURES, COMPACT_SQL, 4)} FROM flows")
def compact_features(spark, sf_dir):
    df = flow_features(flows(spark, sf_dir), "compact")
    return rounded(df.select("seq", "feat.*"), 4)


@query("feature_vector", f"""WITH {EVE_SQL} SELECT seq, CAST(70 AS INTEGER) AS width,
  round(CAST(CAST(tb / greatest(dur, 0.1) AS FLOAT) AS DOUBLE), 2) AS v8,
  round(CAST(CAST(bts / greatest(tb, 1) AS FLOAT) AS DOUBLE), 6) AS v10,
  round(CAST(dest_port AS DOUBLE), 2) AS v18, CASE WHEN k % 4 = 3 THEN value ELSE 0.0 END AS cleaned FROM flows""")
def feature_vector(spark, sf_dir):
    df = assemble(flow_features(no_enrichment(flows(spark, sf_dir))))
    # Three values of four are not finite, and become 0.
    odd = [F.lit(float(x)) for x in ("nan", "inf", "-inf")]
    df = clean_non_finite(df, ["features"]).withColumn("cleaned", finite(
        F.get(F.array(*odd, F.col("value")), F.pmod(F.col("k"), F.lit(4)).cast("int"))
    ))
    v = F.col("features")
    return df.select(
        "seq", F.size(v).alias("width"),
        *[F.round(F.get(v, F.lit(i)).cast("double"), d).alias(f"v{i}") for i, d in ((8, 2), (10, 6), (18, 2))],
        "cleaned",
    )


@query("flow_meta", f"""WITH {EVE_SQL} SELECT seq, us AS ts_us, src_ip, dest_ip,
  CAST(src_port AS INTEGER) AS src_port, CAST(dest_port AS INTEGER) AS dest_port, proto,
  app AS app_proto, flow_id, round(dur, 3) AS duration_s, CAST(tb AS BIGINT) AS total_bytes,
  round(tb / greatest(dur, 0.1), 1) AS byte_rate FROM flows""")
def flow_meta_query(spark, sf_dir):
    m = flow_meta(flows(spark, sf_dir)).select("seq", "meta.*")
    return m.withColumn("ts_us", micros(F.col("timestamp"))).drop("timestamp")


@query("window_meta", f"""WITH {ENRICHED_SQL} SELECT seq, CAST(tb AS BIGINT) AS total_bytes,
  CASE WHEN dk IS NULL THEN '' ELSE 'h' || CAST(dk % 20 AS VARCHAR) END AS dns_names,
  '/p' || CAST(hk % 12 AS VARCHAR) AS http_uri,
  CASE WHEN tk % 8 = 0 THEN '' ELSE 's' || CAST(tk % 8 AS VARCHAR) END AS tls_sni FROM enriched""")
def window_meta_query(spark, sf_dir):
    df = window_meta(enriched(spark, sf_dir))
    return df.select("seq", "total_bytes", F.array_join("dns_queries", ",").alias("dns_names"),
                     "http_uri", "tls_sni")


@query("event_routing", f"""WITH {EVE_SQL} SELECT
  CASE WHEN kind = 'flow' THEN 'flow' WHEN kind IN ('http','tls','dns') THEN 'protocol' ELSE 'other' END AS route,
  count(*) AS n FROM eve GROUP BY 1""")
def event_routing(spark, sf_dir):
    from ..sources.eve import route

    flow, protocol_rows, other = route(eve(spark, sf_dir))
    tagged = [d.select(F.lit(n).alias("route")) for d, n in
              ((flow, "flow"), (protocol_rows, "protocol"), (other, "other"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("route").agg(
        F.count(F.lit(1)).alias("n")
    )


RAW_LABELS = (
    "BENIGN", "DoS Hulk", "DDoS LOIT", "DDOS attack-HOIC", "Web Attack - XSS", "Infiltration x",
    "Bot", "SSH-Bruteforce", "FTP-Patator", "flow=From-Normal-V42",
)
RAW_PROTOS = ("6", "TCP", "17", " udp ", "1", "icmp", "GRE")


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("label_normalize", f"""WITH {EVE_SQL}, raw AS (
  SELECT seq, ({_listed(RAW_LABELS)})[k % {len(RAW_LABELS)} + 1] AS l,
    ({_listed(RAW_PROTOS)})[k % {len(RAW_PROTOS)} + 1] AS p FROM flows)
SELECT seq,
  CASE lower(trim(p)) WHEN '6' THEN 'tcp' WHEN '17' THEN 'udp' WHEN '1' THEN 'icmp' ELSE lower(trim(p)) END AS proto_norm,
  CASE WHEN upper(l) = 'BENIGN' THEN 'Benign' WHEN l LIKE 'DoS%' THEN 'DoS'
    WHEN l LIKE 'DDoS%' OR l LIKE 'DDOS%' THEN 'DDoS' WHEN l LIKE '%Web Attack%' THEN 'WebAttack'
    WHEN l LIKE 'Infiltration%' THEN 'Infiltration' WHEN l LIKE 'Bot%' THEN 'Bot'
    WHEN l LIKE '%Patator%' OR l LIKE '%Bruteforce%' THEN 'BruteForce' ELSE l END AS family,
  lower(l) LIKE '%botnet%' OR lower(l) LIKE '%c&c%' OR lower(l) LIKE '%cc%' OR lower(l) LIKE '%bot%' AS is_botnet,
  CASE WHEN lower(l) LIKE '%bot%' OR lower(l) LIKE '%cc%' OR lower(l) LIKE '%malware%' THEN 'botnet'
    WHEN lower(l) LIKE '%normal%' THEN 'normal' ELSE 'background' END AS kind
FROM raw""")
def label_normalize(spark, sf_dir):
    def pick(values):
        return F.get(F.array(*[F.lit(v) for v in values]),
                     F.pmod(F.col("k"), F.lit(len(values))).cast("int"))

    raw = flows(spark, sf_dir).select("seq", pick(RAW_LABELS).alias("l"), pick(RAW_PROTOS).alias("p"))
    return raw.select(
        "seq", protocol(F.col("p")).alias("proto_norm"), attack_family(F.col("l")).alias("family"),
        mentions(F.col("l")).alias("is_botnet"),
        traffic_kind(F.col("l"), MALWARE_TERMS).alias("kind"),
    )


@query("timestamp_formats", f"""WITH {EVE_SQL} SELECT seq, us AS iso_us, us AS argus_us,
  us - 7200000000 AS argus_fixed_zone_us, (us // 1000000) * 1000000 AS second_us,
  (us // 1000000) * 1000000 AS csv_us, CAST(NULL AS BIGINT) AS bad_us FROM flows""")
def timestamp_formats(spark, sf_dir):
    ts = F.col("ts")
    text = flows(spark, sf_dir).select(
        "seq", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX").alias("iso"),
        F.date_format(ts, "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("argus"),
        F.date_format(ts, "dd/MM/yyyy HH:mm:ss").alias("csv"),
    )
    return text.select(
        "seq",
        micros(parse_ts(F.col("iso"))).alias("iso_us"),
        micros(parse_ts(F.col("argus"), ARGUS_FORMATS)).alias("argus_us"),
        micros(parse_ts(F.col("argus"), ARGUS_FORMATS, tz="+02:00")).alias("argus_fixed_zone_us"),
        micros(parse_ts(F.col("iso"), (ISO,), precision="second")).alias("second_us"),
        micros(parse_ts(F.col("csv"), LABEL_CSV_FORMATS)).alias("csv_us"),
        micros(parse_ts(F.concat(F.lit("x"), F.col("csv")), LABEL_CSV_FORMATS)).alias("bad_us"),
    )


CLASS_OF_K = "CASE k % 6 WHEN 0 THEN 'Benign' WHEN 1 THEN 'DoS' WHEN 2 THEN 'DDoS' WHEN 3 THEN 'WebAttack' WHEN 4 THEN 'Infiltration' ELSE 'Bot' END"


def _classed(spark, sf_dir):
    return class_names(
        flows(spark, sf_dir).withColumn("class_id", F.pmod(F.col("k"), F.lit(6)).cast("int")),
        FLOW_CLASSES, into="label",
    )


@query("coarse_classes", f"""WITH {EVE_SQL} SELECT seq, {CLASS_OF_K} AS label,
  CASE WHEN k % 6 IN (1, 2, 4) THEN 'Volumetric' ELSE {CLASS_OF_K} END AS coarse,
  CASE WHEN k % 6 = 1 THEN 'PortScan->DoS' ELSE {CLASS_OF_K} END AS renamed FROM flows""")
def coarse_classes_query(spark, sf_dir):
    df = coarse_classes(_classed(spark, sf_dir))
    return df.select("seq", "label", "coarse",
                     remap(F.col("label"), {"DoS": "PortScan->DoS"}).alias("renamed"))


@query("noise_filter", f"""WITH {EVE_SQL}, c AS (SELECT *, {CLASS_OF_K} AS label FROM flows)
SELECT seq, label, CAST(dest_port AS INTEGER) AS dest_port FROM c
WHERE NOT (label = 'Bot' AND (dest_port = 53 OR (dest_port = 123 AND proto = 'UDP')
  OR (dest_port IN (67, 68) AND proto = 'UDP') OR dest_ip = '192.168.0.5'))""")
def noise_filter(spark, sf_dir):
    df = drop_infrastructure_noise(_classed(spark, sf_dir), metadata_address="192.168.0.5")
    return df.select("seq", "label", "dest_port")


@query("label_hook", f"""WITH {EVE_SQL} SELECT seq, CASE WHEN k > 50 THEN 1 ELSE 0 END AS label,
  round(dur, 6) AS duration_s FROM flows""")
def label_hook(spark, sf_dir):
    """A caller's own extractor and label function, passed as DataFrame functions."""
    def extractor(df):
        return flow_features(df, "base42")

    def label_fn(df):
        return df.withColumn("label", F.when(F.col("k") > 50, 1).otherwise(0))

    return flows(spark, sf_dir).transform(extractor).transform(label_fn).select(
        "seq", "label", F.round("feat.duration_s", 6).alias("duration_s")
    )
