"""Ground-truth labelling: keys, nearest-in-time joins, rules and intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import protocol
from ..functions.timefmt import micros, minute_of_day
from ..schema import COARSE_CLASSES
from ..session import shared_dir
from .ordering import MAX_GROUP_ROWS, bounded, neighbours, running_totals

#: Columns produced by :func:`five_tuple_key`.
FIVE_TUPLE = ["ep_low", "ep_high", "proto_key"]
MICROS = 1_000_000


def five_tuple_key(
    df: DataFrame,
    src_ip: str = "src_ip",
    src_port: str = "src_port",
    dest_ip: str = "dest_ip",
    dest_port: str = "dest_port",
    proto: str = "proto",
) -> DataFrame:
    """Add a direction-free key: both endpoints in order, normalised protocol."""

    def endpoint(ip: str, port: str) -> Column:
        return F.struct(
            F.trim(F.coalesce(F.col(ip), F.lit(""))).alias("ip"),
            F.coalesce(F.col(port).cast("int"), F.lit(0)).alias("port"),
        )

    ends = endpoint(src_ip, src_port), endpoint(dest_ip, dest_port)
    return df.withColumns({
        "ep_low": F.least(*ends),
        "ep_high": F.greatest(*ends),
        "proto_key": protocol(F.coalesce(F.col(proto), F.lit("tcp"))),
    })


def _reduced_marks(labels: DataFrame, keys, pos: Column, label: str, seq: str) -> DataFrame:
    """First label per (key, position); rows that cannot match are dropped."""
    return (
        labels.select(
            *keys, pos.alias("__pos"), F.col(label).alias("__label"), F.col(seq).alias("__seq")
        )
        .dropna(subset=[*keys, "__pos"])
        .groupBy(*keys, "__pos")
        .agg(F.min_by("__label", "__seq").alias("__label"), F.min("__seq").alias("__seq"))
    )


def _nearest(
    points: DataFrame, marks: DataFrame, keys: Sequence[str], tolerance: int, max_rows: int
) -> DataFrame:
    """Add ``__best`` (gap, seq, label): the closest mark within the tolerance.

    The closest mark is either the last one before the point or the first one
    after it, so both sides travel through one sort of the key and no pair is
    built. Equal distances go to the lower ``__seq``.
    """
    rows = points.withColumn("__point", F.lit(True)).unionByName(
        marks.select(
            *keys, "__pos", F.struct("__pos", "__seq", "__label").alias("__mark"),
            F.lit(False).alias("__point"),
        ),
        allowMissingColumns=True,
    )
    rows = neighbours(rows, keys, ["__pos", "__point"], "__mark", "__left", "__right", max_rows)

    def candidate(side: str) -> Column:
        gap = F.abs(F.col("__pos") - F.col(side)["__pos"])
        return F.when(gap <= tolerance, F.struct(
            gap.alias("gap"), F.col(side)["__seq"].alias("seq"),
            F.col(side)["__label"].alias("label"),
        ))

    return (
        rows.where(F.col("__point"))
        .withColumn("__best", F.least(candidate("__left"), candidate("__right")))
        .drop("__point", "__mark", "__left", "__right")
    )


def nearest_label(
    flows: DataFrame,
    labels: DataFrame,
    keys: Sequence[str] = tuple(FIVE_TUPLE),
    flow_ts: str = "ts",
    label_ts: str = "ts",
    label: str = "label",
    label_seq: str = "seq",
    tolerance_s: float = 5.0,
    into: str = "gt_label",
    diff: str | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Left join of each flow to the label closest in time under its key.

    Accepts ``|dt| <= tolerance_s``; at equal distance the label that comes
    first in its file wins. One shuffle on the key; ``diff`` adds the distance
    in seconds.
    """
    keys = list(keys)
    best = _nearest(
        flows.withColumn("__pos", micros(F.col(flow_ts))),
        _reduced_marks(labels, keys, micros(F.col(label_ts)), label, label_seq),
        keys, int(tolerance_s * MICROS), max_rows,
    )
    extra = [(F.col("__best.gap") / MICROS).alias(diff)] if diff else []
    return best.select(*flows.columns, F.col("__best.label").alias(into), *extra)


def folded_label(
    flows: DataFrame,
    labels: DataFrame,
    keys: Sequence[str],
    flow_ts: str = "ts",
    label_ts: str = "ts",
    label: str = "label",
    label_seq: str = "seq",
    tolerance_s: float = 120.0,
    fold_s: int = 3600,
    into: str = "true_label",
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Nearest label when the label clock may be off by whole hours.

    Distance is measured on a circle of ``fold_s`` seconds. Without a label
    within the tolerance the key's first label is taken; without the key the
    result is null. Only the earliest label per (key, place on the circle) can
    ever win, so a coarse key such as (port, protocol) shrinks to one label
    per place before the join, whatever its size.
    """
    keys = list(keys)
    turn = F.lit(fold_s * MICROS).cast("long")
    tolerance = int(tolerance_s * MICROS)

    def place(ts: str) -> Column:
        return F.pmod(micros(F.col(ts)), turn)

    marks = _reduced_marks(labels, keys, place(label_ts), label, label_seq)
    # Marks near either end of the circle are also seen from the other end.
    shifts = F.filter(
        F.array(
            F.lit(0).cast("long"),
            F.when(F.col("__pos") <= tolerance, turn),
            F.when(F.col("__pos") >= turn - tolerance, -turn),
        ),
        lambda x: x.isNotNull(),
    )
    marks = marks.withColumn("__shift", F.explode(shifts)).withColumn(
        "__pos", F.col("__pos") + F.col("__shift")
    )
    best = _nearest(
        flows.withColumn("__pos", place(flow_ts)), marks, keys, tolerance, max_rows
    )
    # One row per key: few for coarse keys, where one key may own most flows.
    first = bounded(labels.groupBy(*keys).agg(F.min_by(label, label_seq).alias("__first")))
    return best.join(first, keys, "left").select(
        *[F.col(c) for c in flows.columns],
        F.coalesce(F.col("__best.label"), F.col("__first")).alias(into),
    )


#: Key of label rows with endpoints, and of those without.
PRECISE = ["src_ip", "src_port", "dest_ip", "dest_port", "proto"]
COARSE = ["dest_port", "proto"]


def mixed_label(flows: DataFrame, labels: DataFrame, into: str = "true_label", **options) -> DataFrame:
    """:func:`folded_label` where only some label rows have endpoints.

    Rows with endpoints label flows by the full key; what is left takes the
    label of the coarse key from the rows without.
    """
    known = F.col("src_ip").isNotNull() & F.col("src_port").isNotNull() & F.col("dest_ip").isNotNull()
    first = folded_label(flows, labels.where(known), PRECISE, into="__precise", **options)
    both = folded_label(first, labels.where(~known), COARSE, into="__coarse", **options)
    return both.withColumn(into, F.coalesce("__precise", "__coarse")).drop("__precise", "__coarse")


def unmatched(df: DataFrame, label: str = "true_label") -> DataFrame:
    """Flows that found no label."""
    return df.where(F.col(label).isNull())


def default_label(
    flows: DataFrame, labels: DataFrame, scenario: str = "scenario",
    label: str = "gt_label", default: str = "Botnet",
) -> DataFrame:
    """Scenarios without any ground truth: every flow gets the default label."""
    known = bounded(labels.select(scenario).distinct().withColumn("__known", F.lit(True)))
    return (
        flows.join(known, scenario, "left")
        .withColumn(label, F.when(F.col("__known"), F.col(label)).otherwise(F.lit(default)))
        .drop("__known")
    )


def clock_offset(
    flows: DataFrame,
    labels: DataFrame,
    keys: Sequence[str],
    flow_ts: str = "ts",
    label_ts: str = "ts",
    scenario: str = "scenario",
    bins: int = 100,
    horizon_s: float = 7 * 86400,
    snap_s: float = 10.0,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Clock difference per scenario: centre of the modal bin of pair differences.

    All same-key pairs with ``|dt| < horizon_s`` count. A key with no more
    label times than ``bins`` has its pairs put into their bins. For the others
    no pair is built: the number of labels below a time comes from a running
    count, so each distinct flow time asks once per bin edge. The histogram spans the
    smallest to the largest difference; equal extremes widen by half a second;
    the last bin is closed. A centre within ``snap_s`` of a whole hour becomes
    that hour. Scenarios without pairs get 0.
    """
    keys = list(keys)
    group = [scenario, *keys]
    horizon = int(horizon_s * MICROS)
    weighed = (
        flows.select(*group, micros(F.col(flow_ts)).alias("__t")).where(F.col("__t").isNotNull())
        .groupBy(*group, "__t").agg(F.count(F.lit(1)).alias("__w"))
    )
    stamps = (
        labels.select(*group, micros(F.col(label_ts)).alias("__pos"))
        .where(F.col("__pos").isNotNull())
        .groupBy(*group, "__pos").agg(F.count(F.lit(1)).alias("__n"))
    )

    def of_key(rows: DataFrame, keyed_rows: DataFrame) -> DataFrame:
        """Rows with what their key has; null keys are one key."""
        other = keyed_rows.select(*[F.col(c).alias(f"__k_{c}") for c in group],
                                  *[c for c in keyed_rows.columns if c not in group])
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in group])
        return rows.join(other, same).drop(*[f"__k_{c}" for c in group])

    sizes = stamps.groupBy(*group).agg(F.count(F.lit(1)).alias("__labels"))
    few, many = sizes.where(F.col("__labels") <= bins), sizes.where(F.col("__labels") > bins).drop("__labels")

    def labels_below(asks: DataFrame) -> DataFrame:
        """Labels of the key strictly before each asked position."""
        extra = [c for c in asks.columns if c not in (*group, "__pos")]
        rows = of_key(stamps, many).withColumns({
            **{c: F.lit(None).cast(asks.schema[c].dataType) for c in extra},
            "__side": F.lit(1),
        }).unionByName(asks.withColumns({"__n": F.lit(0).cast("long"), "__side": F.lit(0)}))
        # An ask sorts before a label at the same position: strictly below.
        counted = running_totals(
            rows, group,
            [F.col("__pos"), F.col("__side"), *[F.col(c) for c in extra]],
            {"__below": F.col("__n")}, max_rows,
        )
        return counted.where(F.col("__side") == 0).select(*group, "__pos", *extra, "__below")

    bounds = _extremes(weighed, stamps, group, scenario, horizon, max_rows)
    spread = bounds.select(
        scenario,
        (F.col("__lo") - F.when(F.col("__lo") == F.col("__hi"), MICROS / 2).otherwise(0.0)).alias("__from"),
        (F.col("__hi") + F.when(F.col("__lo") == F.col("__hi"), MICROS / 2).otherwise(0.0)).alias("__to"),
        F.col("__hi").alias("__max"),
    )
    spread = bounded(spread)
    # Differences at or above edge e come from labels at or before t - e. The
    # last edge asks for those beyond the maximum, which closes the last bin.
    def below(edge: Column) -> Column:
        """Labels strictly below this differ by the edge or more; those outside the horizon do not count."""
        e = F.col("__from") + (F.col("__to") - F.col("__from")) * edge / bins
        return F.greatest(F.least(
            F.floor(F.col("__t") - e).cast("long") + 1, F.col("__t") + horizon
        ), F.col("__t") - horizon + 1)

    asked = (
        of_key(weighed, many).join(spread, scenario)
        .withColumn("__edge", F.explode(F.sequence(F.lit(0), F.lit(bins))))
        .withColumn("__pos", F.when(F.col("__edge") == bins, F.greatest(F.least(
            F.col("__t") - F.col("__max"), F.col("__t") + horizon
        ), F.col("__t") - horizon + 1).cast("long")).otherwise(below(F.col("__edge"))))
        .select(*group, "__pos", "__edge", "__w")
    )
    # Strictly below pos = at or before t - e.
    above = labels_below(asked).groupBy(scenario, "__edge").agg(
        F.sum(F.col("__below") * F.col("__w")).alias("__above")
    )
    counted = above.select(scenario, "__edge", (
        F.col("__above") - F.lead("__above").over(Window.partitionBy(scenario).orderBy("__edge"))
    ).alias("__pairs")).where(F.col("__edge") < bins)
    # The bin of a pair by division, then set right by the edges above.
    built = of_key(of_key(weighed, few), stamps).where(
        F.abs(F.col("__t") - F.col("__pos")) < horizon
    ).join(spread, scenario)
    share = (F.col("__t") - F.col("__pos") - F.col("__from")) / (F.col("__to") - F.col("__from"))
    guess = F.greatest(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    more = F.least(F.col("__guess") + 1, F.lit(bins - 1))
    built = built.withColumn("__guess", guess).withColumn(
        "__edge", F.when(F.col("__pos") < below(more), more)
        .when(F.col("__pos") < below(F.col("__guess")), F.col("__guess"))
        .otherwise(F.greatest(F.col("__guess") - 1, F.lit(0)))
    ).groupBy(scenario, "__edge").agg(F.sum(F.col("__w") * F.col("__n")).alias("__pairs"))
    per_bin = counted.unionByName(built).groupBy(scenario, "__edge").agg(
        F.sum("__pairs").alias("__pairs")
    ).join(spread, scenario)
    width = (F.col("__to") - F.col("__from")) / bins
    modal = per_bin.groupBy(scenario).agg(F.max_by(
        F.col("__from") + width * (F.col("__edge") + 0.5),
        F.struct(F.col("__pairs"), -F.col("__edge")),
    ).alias("__centre"), F.sum("__pairs").alias("pairs"))
    centre = F.col("__centre") / MICROS
    hour = F.round(centre / 3600.0) * 3600.0
    found = modal.select(
        scenario, "pairs",
        F.when(F.abs(centre - hour) < snap_s, hour).otherwise(centre).alias("offset_s"),
    )
    return (
        flows.select(scenario).distinct().join(found, scenario, "left")
        .select(
            scenario,
            F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"),
            F.coalesce("offset_s", F.lit(0.0)).alias("offset_s"),
        )
    )


def _extremes(weighed, stamps, group, scenario, horizon, max_rows) -> DataFrame:
    """Smallest and largest admissible difference per scenario, without pairs.

    Each flow time asks for the last label before ``t + horizon`` and for the
    first one after ``t - horizon``. A label exactly there is out of reach, so
    it sorts after the first kind of ask and before the second.
    """
    def ask(shift: int, side: int) -> DataFrame:
        return weighed.select(
            *group, (F.col("__t") + shift).alias("__pos"), "__t",
            F.lit(None).cast("long").alias("__m"), F.lit(side).alias("__side"),
        )

    rows = ask(horizon, 0).unionByName(ask(-horizon, 2)).unionByName(
        stamps.select(
            *group, "__pos", F.lit(None).cast("long").alias("__t"),
            F.col("__pos").alias("__m"), F.lit(1).alias("__side"),
        )
    )
    near = neighbours(rows, group, ["__pos", "__side"], "__m", "__prev", "__next", max_rows)
    asked = near.where(F.col("__t").isNotNull()).select(
        scenario, F.col("__side"),
        (F.col("__t") - F.when(F.col("__side") == 0, F.col("__prev")).otherwise(F.col("__next")))
        .alias("__d"),
    ).where(F.abs("__d") < horizon)
    return asked.groupBy(scenario).agg(
        F.min("__d").alias("__lo"), F.max("__d").alias("__hi")
    )


def apply_offset(flows: DataFrame, offsets: DataFrame, ts: str = "ts", scenario: str = "scenario",
                 into: str = "ts_aligned") -> DataFrame:
    """Shift flow times by their scenario's clock offset (one row per scenario)."""
    shifted = F.timestamp_micros(
        micros(F.col(ts)) - F.round(F.col("offset_s") * MICROS).cast("long")
    )
    return (
        flows.join(bounded(offsets.select(scenario, "offset_s")), scenario, "left")
        .withColumn(into, F.when(F.col("offset_s").isNull(), F.col(ts)).otherwise(shifted))
        .drop("offset_s")
    )


# Rules ----------------------------------------------------------------------

# The capture's attacker, victim and server addresses and hours.
ATTACKERS = ("205.174.165.73", "172.16.0.1")
EXTERNAL_ATTACKER = "205.174.165.73"
BOT_VICTIMS = ("192.168.10.15", "192.168.10.9", "192.168.10.14", "192.168.10.5", "192.168.10.8")
SERVERS = ("192.168.10.50", "192.168.10.51")
FLOODED_SERVER = "192.168.10.50"
FLOOD_MINUTES = (1130, 1180)
SCAN_MINUTES = (1010, 1120)
BOT_MINUTES = (780, 855)


def rule_label(
    df: DataFrame,
    ts: str = "ts",
    into: str = "gt_label",
    attackers: Sequence[str] = ATTACKERS,
    external: str = EXTERNAL_ATTACKER,
    bot_victims: Sequence[str] = BOT_VICTIMS,
    servers: Sequence[str] = SERVERS,
    flooded: str = FLOODED_SERVER,
    flood_minutes: tuple[int, int] = FLOOD_MINUTES,
    scan_minutes: tuple[int, int] = SCAN_MINUTES,
    bot_minutes: tuple[int, int] = BOT_MINUTES,
) -> DataFrame:
    """Label by address sets, direction and UTC minute; the first case wins.

    Rows without a readable time are dropped.
    """
    src, dst = F.col("src_ip"), F.col("dest_ip")

    def between(one: Sequence[str], other: Sequence[str]) -> Column:
        return (src.isin(*one) & dst.isin(*other)) | (dst.isin(*one) & src.isin(*other))

    minute = minute_of_day(F.col(ts))
    touches = src.isin(*attackers) | dst.isin(*attackers)
    scanning = minute.between(*scan_minutes)
    return df.where(F.col(ts).isNotNull()).withColumn(
        into,
        F.when(between(attackers, servers), "DDoS")
        .when((dst == flooded) & (F.col("proto") == "TCP") & minute.between(*flood_minutes), "DDoS")
        .when(touches & scanning, "PortScan")
        .when(touches & minute.between(*bot_minutes), "Bot")
        .when(between(bot_victims, attackers), "Bot")
        .when((src == external) | (dst == external), F.when(scanning, "PortScan").otherwise("DDoS"))
        .otherwise("Benign"),
    )


def merged_spans(
    windows: DataFrame, start: str = "start", end: str = "end", max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Windows (both ends inclusive) merged into disjoint spans: ``a, b`` in microseconds.

    A running count of open windows along all their ends: a span begins where
    the count leaves zero and closes where it is back. Windows that touch make
    one span; those without an end, or with their ends in the wrong order,
    count for nothing.
    """
    shared_dir(windows.sparkSession)
    first, last = micros(F.col(start)), micros(F.col(end))
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("pos"), F.lit(1).alias("step")),
        F.struct((F.col("b") + 1).alias("pos"), F.lit(-1).alias("step")),
    ))
    steps = (
        windows.select(first.alias("a"), last.alias("b")).where("a <= b")
        .select(ends.alias("e")).select("e.*")
        .groupBy("pos").agg(F.sum("step").alias("step")).where("step <> 0")
    ).checkpoint()  # both counts below, and the looks at their size, read it
    counted = running_totals(steps, [], [F.col("pos")], {"open": F.col("step")}, max_rows)
    edges = counted.where((F.col("open") == 0) | (F.col("open") == F.col("step"))).select(
        "pos", (F.col("step") > 0).cast("long").alias("begins")
    )
    numbered = running_totals(edges, [], [F.col("pos")], {"span": F.col("begins")}, max_rows)
    return numbered.groupBy("span").agg(F.min("pos").alias("a"), (F.max("pos") - 1).alias("b")).drop("span")


#: Groups that a time bucket is dealt over.
SALTS = 64


def interval_label(
    df: DataFrame,
    windows: DataFrame,
    victims: DataFrame,
    ts: str = "ts",
    into: str = "label",
    bucket_s: int = 3600,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """1 when the time lies in an attack window and an endpoint is a victim.

    ``windows``: start, end (inclusive), any number, overlapping at will.
    ``victims``: ip. The windows are merged into disjoint spans; the flows of
    victims then meet, in time buckets, the latest edge of a span at or before
    them. Flows are never multiplied, no list is collected, and flows without
    a victim stay where they are. A bucket is dealt over ``SALTS`` groups, each
    with a copy of its few edges, so a busy hour is many tasks' work.
    """
    width = F.lit(bucket_s * MICROS).cast("long")

    def bucket(col: Column) -> Column:
        return F.floor(col / width).cast("long")

    spans = merged_spans(windows, max_rows=max_rows)
    # A span is cut at the bounds of its buckets, so that each bucket knows its own edges.
    cut = spans.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("a")), bucket(F.col("b"))))).select(
        "__bucket", F.greatest("a", F.col("__bucket") * width).alias("a"),
        F.least("b", (F.col("__bucket") + 1) * width - 1).alias("b"),
    )
    edges = cut.select("__bucket", F.explode(F.array(
        F.struct(F.col("a").alias("pos"), F.lit(True).alias("inside")),
        F.struct((F.col("b") + 1).alias("pos"), F.lit(False).alias("inside")),
    )).alias("e")).select(
        "__bucket", F.col("e.pos").alias("__pos"), F.lit(False).alias("__flow"),
        F.col("e.inside").alias("__edge"),
    )
    hosts = bounded(victims.select(F.col("ip")).where("ip IS NOT NULL").distinct())
    at = micros(F.col(ts))
    marked = (
        df.join(hosts.withColumnsRenamed({"ip": "src_ip"}).withColumn("__vs", F.lit(1)), "src_ip", "left")
        .join(hosts.withColumnsRenamed({"ip": "dest_ip"}).withColumn("__vd", F.lit(1)), "dest_ip", "left")
        .withColumn("__hit", F.coalesce("__vs", "__vd").isNotNull() & F.col(ts).isNotNull())
    )
    calm = marked.where(~F.col("__hit")).select(*df.columns, F.lit(0).alias(into))
    asked = marked.where("__hit").select(
        *df.columns, bucket(at).alias("__bucket"), at.alias("__pos"), F.lit(True).alias("__flow"),
    )
    salt = F.pmod(F.xxhash64("__pos", "src_ip", "dest_ip"), F.lit(SALTS)).cast("int")
    rows = asked.withColumn("__salt", salt).unionByName(
        edges.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))),
        allowMissingColumns=True,
    )
    # An edge sorts before a flow of the same time.
    so_far = Window.partitionBy("__bucket", "__salt").orderBy("__pos", "__flow").rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = rows.withColumn("__inside", F.last("__edge", ignorenulls=True).over(so_far))
    found = rows.where("__flow").select(
        *df.columns, F.when(F.col("__inside"), 1).otherwise(0).alias(into)
    )
    return calm.unionByName(found)


# Infrastructure traffic that is not an attack by itself.
NOISE_PORTS = {"dns": 53, "ntp": 123, "dhcp_server": 67, "dhcp_client": 68}
METADATA_ADDRESS = "169.254.169.254"


def drop_infrastructure_noise(
    df: DataFrame, label: str = "label", noisy: str = "Bot",
    metadata_address: str = METADATA_ADDRESS,
) -> DataFrame:
    """Remove name, time, address-lease and metadata traffic from one class."""
    port, proto = F.col("dest_port"), F.upper(F.col("proto"))
    lease = [NOISE_PORTS["dhcp_server"], NOISE_PORTS["dhcp_client"]]
    noise = (
        (port == NOISE_PORTS["dns"])
        | ((port == NOISE_PORTS["ntp"]) & (proto == "UDP"))
        | (port.isin(*lease) & (proto == "UDP"))
        | (F.col("dest_ip") == metadata_address)
    )
    return df.where(~((F.col(label) == noisy) & F.coalesce(noise, F.lit(False))))


def coarse_classes(df: DataFrame, label: str = "label", into: str = "coarse",
                   mapping: Mapping[str, str] = COARSE_CLASSES) -> DataFrame:
    """Fine classes merged into the window model's classes."""
    from ..functions.labels import remap

    return df.withColumn(into, remap(F.col(label), mapping))


def class_names(df: DataFrame, names: Mapping[int, str], class_id: str = "class_id",
                into: str = "class_name", missing: str = "Unknown") -> DataFrame:
    """Class id -> name from a literal map."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn(into, F.coalesce(F.try_element_at(pairs, F.col(class_id)), F.lit(missing)))
