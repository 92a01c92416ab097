"""Keyed state of the live pipeline: flow enrichment and per-source buffers.

Two clocks. *Event time* belongs to each key: a row that lies more than ``delay`` behind the latest row of
its key is late; it is not put into the key's state, but it comes out all the same, marked, so that no flow
is lost. *Arrival time* is what the watermark follows: it says how long a key has been idle, and timers on
it evict the key. It only grows from batch to batch, so Spark has no row to drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.enrich import RECORD_TYPES
from ..operators.features import ENRICHED
from ..schema import DNS, HTTP, SESSION_GAP_S, TLS, WINDOW_SIZE

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = {"http": HTTP, "tls": TLS, "dns": DNS}
#: Groups that rows without state are spread over.
SPREAD = 256
#: Rows of a source that a call gives back at once.
OUT_ROWS = 4096
#: Groups that the ids of the enrichment share. A call costs some twenty milliseconds, however few its rows are.
BUCKETS = 1024
#: Column of arrival times, and by how much a later batch may lie behind an earlier one.
ARRIVAL, SLACK = "arrival_ts", "60 seconds"
#: What a row is besides an ordinary one: behind its key's clock, or a key given up by a timer.
LATE, EVICTED = "late", "evicted"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def spread() -> Column:
    """Group 1 to ``SPREAD`` for a row that needs no state of its key."""
    return F.pmod(F.xxhash64("seq"), F.lit(SPREAD)).cast("int") + 1


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The group's rows of this micro-batch by event time, then sequence.

    A micro-batch is bounded by the source (``maxFilesPerTrigger``).
    """
    return pd.concat(list(rows), ignore_index=True).sort_values(["us", "seq"], kind="stable")


def columns_of(batch: pd.DataFrame, *names: str) -> Iterator[tuple]:
    """Rows as plain tuples of the named columns."""
    return zip(*[batch[n].tolist() for n in names])


def behind(delay: str) -> int:
    """An interval such as "300 seconds" in microseconds."""
    return int(pd.Timedelta(delay).total_seconds() * 1_000_000)


def with_arrival(events: DataFrame, arrival: str | None) -> DataFrame:
    """The watermark on arrival: a column of the events, or the time of the micro-batch."""
    at = F.current_timestamp() if arrival is None else F.col(arrival).cast("timestamp")
    return events.withColumn(ARRIVAL, at).withWatermark(ARRIVAL, SLACK)


def forget_timers(handle: StatefulProcessorHandle) -> None:
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)


class EnrichProcessor(StatefulProcessor):
    """First http, tls and dns record per id, consumed by the next flow.

    A group is a bucket of ids: the cost of a call, of its state and of its
    timer is shared by all of them. Its state is a list with one item per id.

    An entry lives ``timeout_s`` of event time from its first record: older
    entries are ignored when a row arrives. The id's latest event time outlives
    the entry; rows more than ``delay_us`` behind it are late, and late flows
    come out without records. Ids without a row for ``timeout_s`` of arrival
    time are evicted, each with a row that says so.
    """

    columns = [ARRIVAL, "body", "note", *ENRICHED.values()]

    def __init__(self, timeout_s: float, delay_us: int):
        self.timeout_us, self.delay_us = int(timeout_s * 1_000_000), delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState(
            "entries", "id long, expires long, clock long, us long, http string, tls string, dns string"
        )

    def held(self) -> dict[int, tuple]:
        """Id -> when it is given up, its clock, and the time and records of its entry."""
        return {i: rest for i, *rest in self.entries.get()} if self.entries.exists() else {}

    def keep(self, held: dict[int, tuple]) -> None:
        if not held:
            self.entries.clear()
            return
        self.entries.put([(i, *rest) for i, rest in held.items()])
        self.handle.registerTimer(min(rest[0] for rest in held.values()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, out = in_order(rows), []
        batch["ms"] = batch[ARRIVAL].dt.as_unit("ms").astype("int64")
        lone = (batch["id"] == 0).all()
        held = {} if lone else self.held()
        for i, kind, us, at, ms, body, record in columns_of(
            batch, "id", "event_type", "us", ARRIVAL, "ms", "body", "record"
        ):
            if i == 0:  # no usable id: nothing to keep
                out.append((at, body, None, None, None, None))
                continue
            is_flow = kind == "flow"
            expires, clock, since, *records = held.get(i, (0, None, None, None, None, None))
            expires = max(expires, ms + self.timeout_us // 1000)
            if clock is not None and us < clock - self.delay_us:
                out.append((at, body if is_flow else None, LATE, None, None, None))
                held[i] = (expires, clock, since, *records)
                continue
            clock = int(us) if clock is None else max(clock, int(us))
            if since is not None and us - since > self.timeout_us:
                since, records = None, [None] * len(RECORD_TYPES)
            if is_flow:
                out.append((at, body, None, *records))
                since, records = None, [None] * len(RECORD_TYPES)
            else:
                since, place = int(us) if since is None else since, RECORD_TYPES.index(kind)
                if records[place] is None:
                    records[place] = record
            held[i] = (expires, clock, since, *records)
        if not lone:
            forget_timers(self.handle)
            self.keep(held)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        held = self.held()
        gone = [rest[0] for rest in held.values() if rest[0] <= fired or rest[0] < now]
        self.keep({i: rest for i, rest in held.items() if not (rest[0] <= fired or rest[0] < now)})
        yield pd.DataFrame(
            [(pd.Timestamp(ms, unit="ms"), None, EVICTED, None, None, None) for ms in gone], columns=self.columns
        )

    def close(self) -> None:
        pass


def _event_schema(events: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in events.schema])


JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def stream_enrich(
    events: DataFrame, timeout_s: float = 300, ts: str = "timestamp", delay: str = "300 seconds",
    arrival: str | None = None, with_notes: bool = False, name: str = "enrichment",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming twin of :func:`flowloom.operators.enrich.enrich_flows`.

    ``seq`` must be present. Every flow comes out once: ``late`` tells the
    flows more than ``delay`` behind the latest row of their id, which have no
    records attached; late records attach to nothing. Rows without a usable id
    are spread, have no clock and are never late.

    ``arrival`` names a column that grows from batch to batch (the default is
    the time of the micro-batch); an id without rows for ``timeout_s`` of it is
    forgotten. The numbers of late flows, late records and forgotten ids are
    metrics of the query under ``name``; ``with_notes`` keeps the rows behind
    the last two, with no columns but ``note``. Ids share ``buckets`` groups;
    their number must stay the same as long as a checkpoint is used.
    """
    use_rocksdb(events.sparkSession)
    usable = F.col("flow_id").isNotNull() & (F.col("flow_id") != 0)
    wanted = (F.col("event_type") == "flow") | (
        F.col("event_type").isin(*RECORD_TYPES) & usable
    )
    record = F.coalesce(*[
        F.when(F.col("event_type") == k, F.coalesce(F.to_json(k), F.lit("{}"))) for k in RECORD_TYPES
    ])
    kept = events.where(wanted)
    body = F.to_json(F.struct(*events.columns), JSON_TIME)
    # Records are given away through ``record``; only flows come out again.
    body = F.when(F.col("event_type") == "flow", body)
    at = F.coalesce(F.when(usable, F.col("flow_id")), F.lit(0)).cast("long")
    bucket = F.pmod(F.xxhash64(F.when(usable, at).otherwise(F.col("seq"))), F.lit(buckets)).cast("int")
    packed = with_arrival(kept.select(
        bucket.alias("bucket"), at.alias("id"),
        *([F.col(arrival)] if arrival else []), F.unix_micros(ts).alias("us"), F.col("seq"),
        "event_type", body.alias("body"), record.alias("record"),
    ), arrival).select("bucket", "id", ARRIVAL, "us", "seq", "event_type", "body", "record")
    layout = T.StructType([
        T.StructField(ARRIVAL, T.TimestampType()), T.StructField("body", T.StringType()),
        T.StructField("note", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ENRICHED.values()],
    ])
    out = (
        packed.groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=EnrichProcessor(timeout_s, behind(delay)), outputStructType=layout,
            outputMode="Append", timeMode="EventTime", eventTimeColumnName=ARRIVAL,
        )
    )
    schema = _event_schema(events)
    note = F.col("note")
    out = out.observe(
        name, F.count_if((note == LATE) & F.col("body").isNotNull()).alias("late_flows"),
        F.count_if((note == LATE) & F.col("body").isNull()).alias("late_records"),
        F.count_if(note == EVICTED).alias("evicted"),
    )
    if not with_notes:
        out = out.where(F.col("body").isNotNull())
    typed = out.select(
        F.from_json("body", schema, JSON_TIME).alias("e"), ARRIVAL, "note",
        F.coalesce(note == LATE, F.lit(False)).alias("late"),
        *[F.from_json(c, KINDS[k]).alias(c) for k, c in ENRICHED.items()],
    )
    return typed.select(
        "e.*", F.col(f"e.{ts}").alias("event_ts"), ARRIVAL, "late", *ENRICHED.values(),
        *(["note"] if with_notes else []),
    )


#: What a buffered row keeps for the behaviour values.
ITEM = T.StructType([
    T.StructField("us", T.LongType()), T.StructField("dest_ip", T.StringType()),
    T.StructField("dest_port", T.IntegerType()), T.StructField("total_bytes", T.LongType()),
    T.StructField("dns_queries", T.ArrayType(T.StringType())),
    T.StructField("http_uri", T.StringType()), T.StructField("tls_sni", T.StringType()),
])
FEATURES = T.StructField("features", T.ArrayType(T.FloatType()))


class BufferProcessor(StatefulProcessor):
    """The last ``size`` rows per source, emptied by a long gap.

    Every row comes out with the buffer after it; without ``partial``, only
    with a full one. ``fire="clear"`` empties the buffer once it is full, so
    full windows do not overlap. Rows flagged ``fast`` pass through, and so do
    late ones: those flagged, and those more than ``delay_us`` behind the
    source's latest row. A source without a row for ``gap_s`` of arrival time
    is evicted, with a row that says so.

    The buffer is a list of typed items. Rows of a micro-batch are appended to
    it; it is written anew only where old ones have to go.
    """

    columns = [ARRIVAL, "body", "note", "window", "window_rows"]

    def __init__(self, size: int, gap_s: float, fire: str, delay_us: int, partial: bool,
                 layout: T.StructType):
        if fire not in ("slide", "clear"):
            raise ValueError("fire must be 'slide' or 'clear'")
        self.size, self.gap_us, self.clears = size, int(gap_s * 1_000_000), fire == "clear"
        self.delay_us, self.partial, self.layout = delay_us, partial, layout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "clock long, last long")
        self.items = handle.getListState("items", self.layout)

    def values(self, batch: pd.DataFrame) -> Iterator[tuple]:
        """The values of each row, with missing numbers and lists as None."""
        def plain(field: T.StructField) -> list:
            column = batch[field.name].tolist()
            if isinstance(field.dataType, T.ArrayType):
                own = float if field.name == "features" else (lambda v: v)
                return [None if x is None else [own(v) for v in x] for x in column]
            own = (lambda v: v) if isinstance(field.dataType, T.StringType) else int
            return [None if x is None or x != x else own(x) for x in column]

        return zip(*[plain(f) for f in self.layout])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, out = in_order(rows), []
        if batch["fast"].all():
            out = [(at, body, LATE if late else None, [], 0)
                   for at, body, late in columns_of(batch, ARRIVAL, "body", "late")]
            yield pd.DataFrame(out, columns=self.columns)
            return
        stored = self.clock.exists()
        clock, last = self.clock.get() if stored else (None, None)
        kept = [tuple(i) for i in self.items.get()] if stored and self.items.exists() else []
        held = len(kept)  # the first ``held`` items are in the list state
        names, seen = self.layout.names, batch[ARRIVAL].max()
        kept = [dict(zip(names, i)) for i in kept]
        taken = columns_of(batch, ARRIVAL, "body", "us", "fast", "late")
        for (at, body, us, fast, late), item in zip(taken, self.values(batch)):
            if len(out) == OUT_ROWS:
                yield pd.DataFrame(out, columns=self.columns)
                out = []
            late = late or (clock is not None and us < clock - self.delay_us)
            if fast or late:
                out.append((at, body, LATE if late else None, [], 0))
                continue
            clock = int(us) if clock is None else max(clock, int(us))
            if last is not None and us - last > self.gap_us:
                kept, held = [], -1
            kept, last = [*kept, dict(zip(names, item))], int(us)
            if len(kept) > self.size:
                kept, held = kept[1:], -1
            full = len(kept) == self.size
            out.append((at, body, None, kept if full or self.partial else [], len(kept)))
            if self.clears and full:
                kept, held, last = [], -1, None
        if clock is not None:
            self.clock.update((clock, last))
            if held < 0 or not stored:
                self.items.clear()
                held = 0
            if kept[held:]:
                self.items.appendList([tuple(i.values()) for i in kept[held:]])
            if stored:
                forget_timers(self.handle)
            self.handle.registerTimer(int(seen.timestamp() * 1000) + self.gap_us // 1000)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clock.clear()
        self.items.clear()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(at, None, EVICTED, [], 0)], columns=self.columns)

    def close(self) -> None:
        pass


def stream_windows(
    flows: DataFrame, key: str = "src_ip", ts: str = "event_ts", size: int = WINDOW_SIZE,
    gap_s: float = SESSION_GAP_S, fire: str = "slide", fast: str | None = None,
    with_features: bool = False, delay: str = "300 seconds", partial: bool = True,
    with_notes: bool = False, name: str = "windows",
) -> DataFrame:
    """Flow rows with ``rows`` (the source's buffer) and ``window_rows``.

    Rows with fewer than ``size`` buffered flows are provisional; without
    ``partial`` they carry no buffer. ``fast`` names a boolean column of rows
    that skip the buffer; they are spread over groups of their own instead of
    meeting at their source. Late rows (a column ``late`` of the input, or more than
    ``delay`` behind the source's latest row) skip it too, with ``late`` set
    and no buffer. The numbers of late rows and of evicted sources are metrics
    of the query under ``name``; ``with_notes`` keeps the rows of evictions,
    with no columns but ``note`` and, the source being gone, no key.
    """
    use_rocksdb(flows.sparkSession)
    quick = F.coalesce(F.col(fast), F.lit(False)) if fast else F.lit(False)
    late = F.coalesce(F.col("late"), F.lit(False)) if "late" in flows.columns else F.lit(False)
    item = T.StructType(ITEM.fields + ([FEATURES] if with_features else []))
    rows = flows if ARRIVAL in flows.columns else with_arrival(flows, None)
    own = [c for c in rows.columns if c not in (ARRIVAL, "late")]
    packed = rows.withColumn("us", F.unix_micros(ts)).select(
        F.when(~(quick | late), F.col(key)).alias(key),
        F.when(quick | late, spread()).otherwise(F.lit(0)).alias("lone"),
        ARRIVAL, "seq", (quick | late).alias("fast"), late.alias("late"),
        F.to_json(F.struct(*own), JSON_TIME).alias("body"),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in item],
    )
    layout = T.StructType([
        T.StructField(ARRIVAL, T.TimestampType()), T.StructField("body", T.StringType()),
        T.StructField("note", T.StringType()), T.StructField("window", T.ArrayType(item)),
        T.StructField("window_rows", T.IntegerType()),
    ])
    out = packed.groupBy(key, "lone").transformWithStateInPandas(
        statefulProcessor=BufferProcessor(size, gap_s, fire, behind(delay), partial, item),
        outputStructType=layout, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName=ARRIVAL,
    )
    note = F.col("note")
    out = out.observe(
        name, F.count_if(note == LATE).alias("late_rows"), F.count_if(note == EVICTED).alias("evicted")
    )
    if not with_notes:
        out = out.where(F.col("body").isNotNull())
    schema = T.StructType([f for f in _event_schema(rows) if f.name in own])
    return out.select(
        F.from_json("body", schema, JSON_TIME).alias("e"), ARRIVAL,
        F.coalesce(note == LATE, F.lit(False)).alias("late"), F.col("window").alias("rows"),
        "window_rows", "note",
    ).select("e.*", ARRIVAL, "late", "rows", "window_rows", *(["note"] if with_notes else []))
