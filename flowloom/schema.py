"""Record layouts and the fixed feature order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# Feature names in model order. -------------------------------

BASE_FEATURES = [
    "duration_s", "pkts_toserver", "pkts_toclient",
    "bytes_toserver", "bytes_toclient", "total_pkts", "total_bytes",
    "pkt_rate", "byte_rate", "bytes_per_pkt",
    "upload_byte_ratio", "upload_pkt_ratio", "byte_asymmetry",
    "download_byte_ratio", "download_pkt_ratio",
    "flow_age", "is_unidirectional", "pkt_size_variance_proxy",
    "dest_port", "src_port",
    "is_well_known_port", "is_registered_port", "is_high_port",
    "is_same_port", "is_ipv6", "is_tcp", "is_udp", "is_icmp",
    "app_http", "app_dns", "app_tls", "app_dcerpc", "app_smb", "app_rdp",
    "app_failed", "app_unknown",
    "state_established", "state_closed", "state_new",
    "reason_timeout", "reason_rst", "reason_fin",
]
ENRICHED_FEATURES = [
    "tcp_syn", "tcp_ack", "tcp_fin", "tcp_rst", "tcp_psh",
    "http_method_get", "http_method_post", "http_method_head", "http_method_other",
    "http_status_2xx", "http_status_3xx", "http_status_4xx", "http_status_5xx",
    "http_content_type_html", "http_content_type_octet",
    "http_content_type_json", "http_content_type_other",
    "tls_exists", "tls_sni_exists",
    "dns_exists", "dns_query_a", "dns_query_aaaa", "dns_query_mx", "dns_query_other",
    "dns_rcode_noerror", "dns_rcode_nxdomain", "dns_rcode_refused", "dns_rcode_other",
]
FLOW_FEATURES = BASE_FEATURES + ENRICHED_FEATURES
COMPACT_FEATURES = [
    "src_port", "dest_port", "is_tcp", "is_udp", "is_icmp", "flow_age",
    "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient",
    "total_pkts", "total_bytes", "pkt_rate", "byte_rate", "avg_pkt_size",
    "mean_pkt_size", "bytes_per_pkt_s2c", "bytes_per_pkt_c2s",
    "pkt_ratio", "byte_ratio",
    "tcp_fin", "tcp_syn", "tcp_rst", "tcp_psh", "tcp_ack", "tcp_urg",
    "state_new", "state_established", "state_closed",
    "has_http", "http_length", "http_status", "has_tls", "has_dns",
    "src_port_well_known", "dest_port_well_known",
]
WINDOW_FEATURES = [
    "beacon_interval_mean", "beacon_interval_std",
    "dst_ip_entropy", "dns_per_min",
    "uri_entropy", "same_dst_port_ratio",
    "tls_sni_reuse", "payload_size_variance",
]
# Width of the compact profile once padded to the model's input.
MODEL_WIDTH = 70

# Class ids of the flow model and of the window model.
FLOW_CLASSES = {
    0: "Benign", 1: "DoS", 2: "DDoS", 3: "WebAttack", 4: "Infiltration", 5: "Bot",
}
WINDOW_CLASSES = {0: "Volumetric", 1: "WebAttack", 2: "Bot"}
# Fine label -> window-model label.
COARSE_CLASSES = {
    "Benign": "Benign",
    "DoS": "Volumetric", "DDoS": "Volumetric", "Infiltration": "Volumetric",
    "WebAttack": "WebAttack", "Bot": "Bot",
}
DEFAULT_THRESHOLD = 0.84
WINDOW_CONFIDENCE = 0.50
WINDOW_SIZE = 40
SESSION_GAP_S = 300

# Record layouts. ------------------------------------------------------------


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _D, _I, _L, _B = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(),
)

HTTP = _struct(
    ("http_method", _S), ("status", _I), ("http_content_type", _S),
    ("content_type", _S), ("url", _S), ("length", _L),
)
TLS = _struct(("sni", _S))
DNS = _struct(
    ("queries", T.ArrayType(_struct(("rrname", _S), ("rrtype", _S)))), ("rcode", _S),
)
FLOW = _struct(
    ("pkts_toserver", _D), ("pkts_toclient", _D),
    ("bytes_toserver", _D), ("bytes_toclient", _D),
    ("start", T.TimestampType()), ("end", T.TimestampType()),
    ("state", _S), ("reason", _S), ("age", _D),
)
TCP = _struct(
    ("tcp_flags_ts", _S), ("tcp_flags_tc", _S),
    ("syn", _B), ("ack", _B), ("fin", _B), ("rst", _B), ("psh", _B),
)

#: Typed event table: what :func:`flowloom.sources.eve.read_eve` returns.
EVE = _struct(
    ("event_type", _S), ("timestamp", T.TimestampType()), ("flow_id", _L),
    ("src_ip", _S), ("src_port", _I), ("dest_ip", _S), ("dest_port", _I),
    ("proto", _S), ("app_proto", _S), ("ip_v", _I),
    ("flow", FLOW), ("tcp", TCP), ("http", HTTP), ("tls", TLS), ("dns", DNS),
)


def _as_text(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    return kind if isinstance(kind, T.BooleanType) else T.StringType()


def _with_variant(layout: T.StructType, path: Sequence[str]) -> T.StructType:
    """The layout with one field kept as the JSON value it is."""
    name, *rest = path
    return T.StructType([
        f if f.name != name else T.StructField(name, _with_variant(f.dataType, rest) if rest else T.VariantType())
        for f in layout
    ])


#: JSON scan layout: scalars stay text, so a port sent as ``"80"`` is kept. The flags of the answering
#: side are hexadecimal as text and decimal as a number, so their kind is kept.
EVE_TEXT = _with_variant(T.StructType(
    _as_text(EVE).fields + [T.StructField("_corrupt_record", _S)]
), ("tcp", "tcp_flags_tc"))

BINETFLOW = _struct(*[
    (name, _S) for name in (
        "StartTime", "Dur", "Proto", "SrcAddr", "Sport", "Dir", "DstAddr", "Dport",
        "State", "sTos", "dTos", "TotPkts", "TotBytes", "SrcBytes", "Label",
    )
])

ALERT_AI = _struct(
    ("label", _S), ("confidence", _D), ("stage", _S), ("xgb_class", _I),
    ("xgb_label", _S), ("duration_s", _D), ("total_bytes", _L), ("byte_rate", _D),
)
