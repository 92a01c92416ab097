"""The events table read as network events.

A fixed projection, so that every operator runs on that table: record types,
addresses, volumes and protocol fields derive from its ids, times and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..schema import DNS, EVE, FLOW, HTTP, TCP, TLS

# How the table's columns map to network fields.
RECORD_KINDS = {"signup": "http", "view": "dns", "click": "tls"}
DEST_PORTS = (80, 443, 53, 22, 8080, 50000)
APPS = ("http", "tls", "dns", "failed")
STATES = ("established", "closed", "new")
REASONS = ("timeout", "rst", "fin")
METHODS = ("GET", "POST", "HEAD", "PUT")
QUERY_TYPES = ("A", "AAAA", "MX", "TXT")
CONTENT_TYPES = ("text/html", "application/octet-stream", "application/json", "image/png", "")
RCODES = ("NOERROR", "NXDOMAIN", "REFUSED", "SERVFAIL", "")


def _pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def _record(layout: T.StructType, **values: Column) -> Column:
    return F.struct(*[
        (values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in layout
    ])


def events_as_eve(events: DataFrame) -> DataFrame:
    """Typed event rows plus ``seq``, ``ts``, ``k``, ``event_id``, ``user_id`` and ``value``."""
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.coalesce(
        *[F.when(F.col("event_type") == a, b) for a, b in RECORD_KINDS.items()], F.lit("flow")
    )
    base = events.select(
        kind.alias("event_type"), eid.alias("event_id"), "user_id", "value",
        F.col("ts").cast("timestamp").alias("ts"), k.alias("k"),
    )
    k = F.col("k")
    flow = _record(
        FLOW,
        pkts_toserver=1 + F.pmod(eid, F.lit(17)), pkts_toclient=F.pmod(eid, F.lit(11)),
        bytes_toserver=F.floor(F.col("value") * 100), bytes_toclient=k * 37,
        start=F.col("ts"),
        end=F.timestamp_micros(
            F.unix_micros("ts") + F.floor("value").cast("long") * F.lit(1_000_000).cast("long")
        ),
        state=_pick(STATES, k), reason=_pick(REASONS, k), age=F.floor("value"),
    )
    is_kind = {n: F.col("event_type") == n for n in ("flow", "http", "tls", "dns")}
    http = _record(
        HTTP, http_method=_pick(METHODS, k), status=200 + F.pmod(k, F.lit(5)) * 100,
        http_content_type=_pick(CONTENT_TYPES, k), content_type=_pick(CONTENT_TYPES, k),
        url=F.concat(F.lit("/p"), F.pmod(k, F.lit(12)).cast("string")), length=k * 10,
    )
    dns = _record(
        DNS, rcode=_pick(RCODES, k),
        queries=F.array(F.struct(
            F.concat(F.lit("h"), F.pmod(k, F.lit(20)).cast("string")).alias("rrname"),
            _pick(QUERY_TYPES, k).alias("rrtype"),
        )),
    )
    sni = F.when(F.pmod(k, F.lit(8)) == 0, "").otherwise(
        F.concat(F.lit("s"), F.pmod(k, F.lit(8)).cast("string"))
    )
    values = {
        "timestamp": F.col("ts"), "flow_id": F.expr("event_id div 5"),
        "src_ip": F.concat(F.lit("10.0.0."), F.pmod(F.col("user_id"), F.lit(250)).cast("string")),
        "src_port": (1024 + F.pmod(eid, F.lit(50000))).cast("int"),
        "dest_ip": F.concat(F.lit("192.168.0."), F.pmod(k, F.lit(16)).cast("string")),
        "dest_port": _pick(DEST_PORTS, k),
        "proto": F.when(F.pmod(eid, F.lit(3)) == 0, "UDP").otherwise("TCP"),
        "app_proto": _pick(APPS, k), "ip_v": F.lit(4),
        "flow": F.when(is_kind["flow"], flow),
        "tcp": F.when(is_kind["flow"], _record(TCP, tcp_flags_ts=F.hex(F.pmod(eid, F.lit(32))),
                                              tcp_flags_tc=F.hex(F.pmod(eid, F.lit(64))))),
        "http": F.when(is_kind["http"], http),
        "tls": F.when(is_kind["tls"], _record(TLS, sni=sni)),
        "dns": F.when(is_kind["dns"], dns),
    }
    return base.select(
        "event_type", *[values[f.name].cast(f.dataType).alias(f.name) for f in EVE if f.name != "event_type"],
        eid.alias("seq"), "ts", "k", "event_id", "user_id", "value",
    )
