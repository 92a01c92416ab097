"""Per-flow feature projections (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.coerce import bit_flag, flag, hex_value, number, text, whole
from ..functions.timefmt import micros
from ..schema import (
    BASE_FEATURES, COMPACT_FEATURES, FLOW_FEATURES, MODEL_WIDTH,
)

# Thresholds, masks and vocabularies of the feature set.
DURATION_FLOOR_S = 0.1
FIRST_REGISTERED_PORT, FIRST_HIGH_PORT = 1024, 49152
APP_PROTOCOLS = ("http", "dns", "tls", "dcerpc", "smb", "rdp", "failed")
FLOW_STATES = ("established", "closed", "new")
CLOSE_REASONS = ("timeout", "rst", "fin")
TCP_MASKS = {"syn": 0x02, "ack": 0x10, "fin": 0x01, "rst": 0x04, "psh": 0x08, "urg": 0x20}
HTTP_METHODS = ("GET", "POST", "HEAD")
DNS_TYPES = ("A", "AAAA", "MX")
DNS_CODES = ("NOERROR", "NXDOMAIN", "REFUSED")
WELL_KNOWN_PORTS = (80, 443, 53, 22, 21, 25, 110, 143, 3389, 8080)
COMPACT_EPSILON = 1e-6

#: Columns holding the protocol records attached to a flow.
ENRICHED = {"http": "enr_http", "tls": "enr_tls", "dns": "enr_dns"}

PROFILES = {
    "serve": FLOW_FEATURES,
    "train": FLOW_FEATURES,
    "base42": BASE_FEATURES,
    "compact": COMPACT_FEATURES,
}


def _present_or(kind: str, value: Column) -> Column:
    """Null when there is no record of this kind attached."""
    return F.when(F.col(ENRICHED[kind]).isNotNull(), value)


def duration_s() -> Column:
    """Seconds from start (else the event time) to end; never negative, 0 when unknown."""
    begin = F.coalesce(F.col("flow.start"), F.col("timestamp"))
    spent = (micros(F.col("flow.end")) - micros(begin)) / F.lit(1e6)
    return F.coalesce(F.greatest(spent, F.lit(0.0)), F.lit(0.0))


def _volumes(df: DataFrame, floor: float) -> DataFrame:
    """Shared terms, computed once and referenced by the features."""
    sized = df.withColumns({
        "_dur": duration_s(),
        "_pts": number(F.col("flow.pkts_toserver")),
        "_ptc": number(F.col("flow.pkts_toclient")),
        "_bts": number(F.col("flow.bytes_toserver")),
        "_btc": number(F.col("flow.bytes_toclient")),
        "_age": number(F.col("flow.age")),
        "_dp": whole(F.col("dest_port")),
        "_sp": whole(F.col("src_port")),
        "_proto": F.upper(text(F.col("proto"))),
        "_app": F.lower(text(F.col("app_proto"), "unknown")),
        "_state": F.lower(text(F.col("flow.state"))),
        "_reason": F.lower(text(F.col("flow.reason"))),
    })
    return sized.withColumns({
        "_tp": F.col("_pts") + F.col("_ptc"),
        "_tb": F.col("_bts") + F.col("_btc"),
        "_sd": F.greatest(F.col("_dur"), F.lit(floor)),
    })


def _base(fix_icmpv6: bool) -> dict[str, Column]:
    c = F.col
    packets = F.greatest(c("_tp"), F.lit(1.0))
    size = F.greatest(c("_tb"), F.lit(1.0))
    out = {
        "duration_s": c("_dur"),
        "pkts_toserver": c("_pts"), "pkts_toclient": c("_ptc"),
        "bytes_toserver": c("_bts"), "bytes_toclient": c("_btc"),
        "total_pkts": c("_tp"), "total_bytes": c("_tb"),
        "pkt_rate": c("_tp") / c("_sd"),
        "byte_rate": c("_tb") / c("_sd"),
        "bytes_per_pkt": c("_tb") / packets,
        "upload_byte_ratio": c("_bts") / size,
        "upload_pkt_ratio": c("_pts") / packets,
        "byte_asymmetry": F.abs(c("_bts") - c("_btc")) / size,
        "download_byte_ratio": c("_btc") / size,
        "download_pkt_ratio": c("_ptc") / packets,
        "flow_age": c("_age"),
        "is_unidirectional": flag(c("_ptc") == 0),
        "pkt_size_variance_proxy": F.abs(
            c("_bts") / F.greatest(c("_pts"), F.lit(1.0))
            - c("_btc") / F.greatest(c("_ptc"), F.lit(1.0))
        ),
        "dest_port": c("_dp").cast("double"),
        "src_port": c("_sp").cast("double"),
        "is_well_known_port": flag(c("_dp") < FIRST_REGISTERED_PORT),
        "is_registered_port": flag(
            (c("_dp") >= FIRST_REGISTERED_PORT) & (c("_dp") < FIRST_HIGH_PORT)
        ),
        "is_high_port": flag(c("_dp") >= FIRST_HIGH_PORT),
        "is_same_port": flag(c("_sp") == c("_dp")),
        "is_ipv6": flag(c("ip_v") == 6),
        "is_tcp": flag(c("_proto") == "TCP"),
        "is_udp": flag(c("_proto") == "UDP"),
        # The name is upper-cased first, so "ICMPv6" only matches when asked for.
        "is_icmp": flag(c("_proto").isin("ICMP", *(["ICMPV6"] if fix_icmpv6 else []))),
    }
    for app in APP_PROTOCOLS:
        out[f"app_{app}"] = flag(c("_app") == app)
    out["app_unknown"] = flag(~c("_app").isin(*APP_PROTOCOLS))
    for state in FLOW_STATES:
        out[f"state_{state}"] = flag(c("_state") == state)
    for reason in CLOSE_REASONS:
        out[f"reason_{reason}"] = flag(c("_reason") == reason)
    return out


def _tcp(profile: str) -> dict[str, Column]:
    if profile == "train":
        return {
            f"tcp_{f}": flag(F.col(f"tcp.{f}")) for f in ("syn", "ack", "fin", "rst", "psh")
        }
    value = hex_value(F.col("tcp.tcp_flags_ts"))
    return {f"tcp_{f}": bit_flag(value, TCP_MASKS[f]) for f in ("syn", "ack", "fin", "rst", "psh")}


def _http(profile: str) -> dict[str, Column]:
    train = profile == "train"
    record = F.col(ENRICHED["http"])
    here = record.isNotNull()
    method = F.upper(text(record["http_method"]))
    status = F.coalesce(record["status"].cast("int"), F.lit(0))
    kind = F.lower(text(record["content_type" if train else "http_content_type"]))
    html, json = kind.contains("html"), kind.contains("json")
    out = {f"http_method_{m.lower()}": flag(here & (method == m)) for m in HTTP_METHODS}
    other = ~method.isin(*HTTP_METHODS)
    out["http_method_other"] = flag(here & (other if train else other & (method != "")))
    for hundreds in (2, 3, 4):
        out[f"http_status_{hundreds}xx"] = flag(
            here & (F.floor(status / 100) == hundreds)
        )
    top = status >= 500
    out["http_status_5xx"] = flag(here & (top & (status < 600) if train else top))
    if train:
        octet = kind.contains("octet")
        rest = ~kind.isin("html", "octet", "json", "")
    else:
        octet = kind.contains("octet-stream") | kind.contains("binary")
        rest = (kind != "") & ~(html | octet | json)
    out["http_content_type_html"] = flag(here & html)
    out["http_content_type_octet"] = flag(here & octet)
    out["http_content_type_json"] = flag(here & json)
    out["http_content_type_other"] = flag(here & rest)
    return out


def _tls_dns() -> dict[str, Column]:
    tls, dns = F.col(ENRICHED["tls"]), F.col(ENRICHED["dns"])
    # A query without a type counts as an "other" type, like any unlisted one.
    types = F.transform(
        F.coalesce(dns["queries"], F.array().cast(T.ArrayType(T.StructType([
            T.StructField("rrname", T.StringType()), T.StructField("rrtype", T.StringType()),
        ])))),
        lambda q: F.upper(text(q["rrtype"])),
    )
    rcode = F.upper(text(dns["rcode"]))
    has = dns.isNotNull()
    out = {
        "tls_exists": flag(tls.isNotNull()),
        "tls_sni_exists": flag(text(tls["sni"]) != ""),
        "dns_exists": flag(has),
    }
    for kind in DNS_TYPES:
        out[f"dns_query_{kind.lower()}"] = flag(has & F.array_contains(types, kind))
    listed = F.array(*[F.lit(k) for k in DNS_TYPES])
    out["dns_query_other"] = flag(has & (F.size(F.array_except(types, listed)) > 0))
    for code in DNS_CODES:
        out[f"dns_rcode_{code.lower()}"] = flag(has & (rcode == code))
    out["dns_rcode_other"] = flag(has & (rcode != "") & ~rcode.isin(*DNS_CODES))
    return out


def _compact() -> dict[str, Column]:
    c, eps = F.col, F.lit(COMPACT_EPSILON)
    bits = hex_value(c("tcp.tcp_flags_tc"))
    mean_size = c("_tb") / (c("_tp") + eps)
    out = {
        "src_port": c("_sp").cast("double"), "dest_port": c("_dp").cast("double"),
        "is_tcp": flag(c("_proto") == "TCP"), "is_udp": flag(c("_proto") == "UDP"),
        "is_icmp": flag(c("_proto") == "ICMP"),
        "flow_age": c("_age"),
        "pkts_toserver": c("_pts"), "pkts_toclient": c("_ptc"),
        "bytes_toserver": c("_bts"), "bytes_toclient": c("_btc"),
        "total_pkts": c("_tp"), "total_bytes": c("_tb"),
        "pkt_rate": c("_tp") / (c("_age") + eps),
        "byte_rate": c("_tb") / (c("_age") + eps),
        "avg_pkt_size": mean_size, "mean_pkt_size": mean_size,
        "bytes_per_pkt_s2c": c("_btc") / (c("_ptc") + eps),
        "bytes_per_pkt_c2s": c("_bts") / (c("_pts") + eps),
        "pkt_ratio": c("_pts") / (c("_ptc") + eps),
        "byte_ratio": c("_bts") / (c("_btc") + eps),
    }
    for name in ("fin", "syn", "rst", "psh", "ack", "urg"):
        out[f"tcp_{name}"] = bit_flag(bits, TCP_MASKS[name])
    for state in ("new", "established", "closed"):
        out[f"state_{state}"] = flag(c("_state") == state)
    out["has_http"] = flag(c("http").isNotNull())
    out["http_length"] = number(c("http.length"))
    out["http_status"] = number(c("http.status"))
    out["has_tls"] = flag(c("tls").isNotNull())
    out["has_dns"] = flag(c("dns").isNotNull())
    out["src_port_well_known"] = flag(c("_sp").isin(*WELL_KNOWN_PORTS))
    out["dest_port_well_known"] = flag(c("_dp").isin(*WELL_KNOWN_PORTS))
    return out


def flow_features(
    df: DataFrame,
    profile: str = "serve",
    duration_floor: float = DURATION_FLOOR_S,
    fix_icmpv6: bool = False,
    into: str = "feat",
) -> DataFrame:
    """Add a struct column of named double features to flow rows.

    Profiles: ``serve`` (70), ``train`` (70, boolean TCP flags and the
    training-side HTTP rules), ``base42``, ``compact`` (36). The first two read
    the attached protocol records (see :func:`flowloom.operators.enrich.enrich_flows`);
    features of a missing record are 0.
    """
    sized = _volumes(df, duration_floor)
    if profile == "compact":
        exprs = _compact()
    else:
        exprs = _base(fix_icmpv6)
        if profile != "base42":
            exprs |= {**_tcp(profile), **_http(profile), **_tls_dns()}
    names = PROFILES[profile]
    packed = sized.withColumn(into, F.struct(*[exprs[n].alias(n) for n in names]))
    return packed.drop(*[c for c in packed.columns if c.startswith("_") and c not in df.columns])


def no_enrichment(df: DataFrame) -> DataFrame:
    """Flow rows with empty attachments, for sources that carry flows only."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({
        col: F.lit(None).cast(kinds[name]) for name, col in ENRICHED.items()
    })


def assemble(
    df: DataFrame, profile: str = "serve", source: str = "feat", into: str = "features"
) -> DataFrame:
    """Pack the feature struct into ``array<float>`` in the fixed order.

    The compact profile is padded with zeros to the model width.
    """
    cols = [F.col(source)[n] for n in PROFILES[profile]]
    if profile == "compact":
        cols += [F.lit(0.0)] * (MODEL_WIDTH - len(cols))
    return df.withColumn(into, F.array(*cols).cast("array<float>"))


def flow_meta(df: DataFrame, duration_floor: float = DURATION_FLOOR_S, into: str = "meta") -> DataFrame:
    """Alert-facing description of a flow as a struct."""
    sized = _volumes(df, duration_floor)
    meta = F.struct(
        F.col("timestamp"),
        text(F.col("src_ip")).alias("src_ip"), text(F.col("dest_ip")).alias("dest_ip"),
        F.col("_sp").alias("src_port"), F.col("_dp").alias("dest_port"),
        F.col("_proto").alias("proto"), F.col("_app").alias("app_proto"),
        F.col("flow_id"),
        F.round("_dur", 3).alias("duration_s"),
        F.col("_tb").cast("long").alias("total_bytes"),
        F.round(F.col("_tb") / F.col("_sd"), 1).alias("byte_rate"),
    )
    packed = sized.withColumn(into, meta)
    return packed.drop(*[c for c in packed.columns if c.startswith("_") and c not in df.columns])


def window_meta(df: DataFrame) -> DataFrame:
    """Columns the sliding windows read: endpoint, size, queried names, URI, SNI.

    A missing address is the empty text and a missing port 0, so that flows
    without them, as in ICMP, count in entropy and port shares.
    """
    names = F.filter(
        F.transform(F.col(ENRICHED["dns"])["queries"], lambda q: q["rrname"]),
        lambda v: v.isNotNull() & (v != ""),
    )
    return df.withColumns({
        "dest_ip": text(F.col("dest_ip")),
        "dest_port": whole(F.col("dest_port")),
        "total_bytes": (
            number(F.col("flow.bytes_toserver")) + number(F.col("flow.bytes_toclient"))
        ).cast("long"),
        "dns_queries": F.coalesce(names, F.array().cast("array<string>")),
        "http_uri": F.col(ENRICHED["http"])["url"],
        "tls_sni": F.col(ENRICHED["tls"])["sni"],
    })


def label_columns(df: DataFrame, **values: Column | str) -> DataFrame:
    """Attach ground-truth metadata columns (label, scenario, family, dataset)."""
    return df.withColumns({
        k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()
    })
