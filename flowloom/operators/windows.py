"""Sessions by inactivity gap and count windows inside them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lists
from ..functions.timefmt import micros
from ..schema import SESSION_GAP_S, WINDOW_FEATURES, WINDOW_SIZE
from .ordering import (
    MAX_GROUP_ROWS, _attach, row_numbers, split_heavy, with_halo,
)


def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    order: Sequence[str] = ("seq",),
    gap_s: float = SESSION_GAP_S,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``session`` (0-based per key) and ``session_row`` (1-based).

    A new session starts when the gap to the previous row of the key is
    strictly longer than ``gap_s``. Rows are ordered by time, then ``order``.
    """
    keys = list(keys)
    limit = F.lit(int(gap_s * 1_000_000)).cast("long")
    at = micros(F.col(ts))
    sort = [F.col(ts), *[F.col(c) for c in order]]
    light, heavy = split_heavy(df, keys, max_rows)
    parts = []

    def numbered(rows: DataFrame, part: list[str], by: list[Column]) -> DataFrame:
        """Openings so far and the row of the last one; a single sort serves all."""
        w = Window.partitionBy(*part).orderBy(*by)
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        return (
            rows.withColumns({
                "__opens": (at - F.lag(at).over(w)) > limit,
                "__n": F.row_number().over(w).cast("long"),
            })
            .withColumns({
                "session": F.count_if(F.col("__opens")).over(so_far),
                "__begun": F.max(F.when(F.col("__opens"), F.col("__n"))).over(so_far),
            })
        )

    if light is not None:
        parts.append(numbered(light, keys, sort).withColumn(
            "session_row", F.col("__n") - F.coalesce("__begun", F.lit(1)) + 1
        ))
    if heavy is not None:
        ranked = row_numbers(heavy, keys, sort, "__rn", max_rows)
        # One row of halo gives the first row of a chunk its predecessor.
        chunk = [*keys, "__chunk"]
        marked = numbered(
            with_halo(ranked, "__rn", max_rows, 1), chunk, [F.col("__rn")]
        )
        # The halo row itself never opens a session in its chunk.
        own = marked.where(~F.col("__halo"))
        earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = own.groupBy(*chunk).agg(
            F.count_if("__opens").alias("__opened"),
            F.max(F.when(F.col("__opens"), F.col("__rn"))).alias("__last"),
        ).select(
            *chunk,
            F.coalesce(F.sum("__opened").over(earlier), F.lit(0).cast("long")).alias("__base"),
            F.coalesce(F.max("__last").over(earlier), F.lit(1).cast("long")).alias("__begin"),
        )
        so_far = Window.partitionBy(*chunk).orderBy("__rn").rowsBetween(
            Window.unboundedPreceding, 0
        )
        # ``carry`` holds one row per max_rows rows of a heavy key.
        placed = _attach(own, F.broadcast(carry), chunk)
        begin = F.coalesce(
            F.max(F.when(F.col("__opens"), F.col("__rn"))).over(so_far), F.col("__begin")
        )
        parts.append(placed.withColumns({
            "session_row": F.col("__rn") - begin + 1,
            "session": F.col("session") + F.col("__base"),
        }))
    wanted = [*df.columns, "session", "session_row"]
    out = parts[0].select(*wanted)
    for part in parts[1:]:
        out = out.unionByName(part.select(*wanted))
    return out


def session_totals(
    df: DataFrame, keys: Sequence[str], ts: str, gap_s: float, max_rows: int = MAX_GROUP_ROWS,
    **aggregates: Column
) -> DataFrame:
    """Per-session aggregates only: :func:`sessionize`, then a plain aggregate.

    A source with most of the rows is split by ``sessionize`` and merged
    before the shuffle of the aggregate.
    """
    kept = sessionize(df, keys, ts, [], gap_s, max_rows)
    return kept.groupBy(*keys, "session").agg(
        F.min(ts).alias("session_start"), *[c.alias(n) for n, c in aggregates.items()]
    )


def _frames(keys: Sequence[str], size: int):
    """Windows over one chunk of one session: last ``size`` rows, last deltas."""
    w = Window.partitionBy(*keys, "session", "__chunk").orderBy("session_row")
    return w, w.rowsBetween(-(size - 1), 0), w.rowsBetween(-(size - 2), 0)


def _full(size: int, stride: int) -> Column:
    row = F.col("session_row")
    return (row >= size) & (F.pmod(row - size, F.lit(stride)) == 0)


def sliding_behaviour(
    df: DataFrame,
    keys: Sequence[str] = ("src_ip",),
    ts: str = "ts",
    size: int = WINDOW_SIZE,
    stride: int = 1,
    keep: Mapping[str, Column] | None = None,
    chunk_rows: int = MAX_GROUP_ROWS,
    partial: bool = False,
    collect: Mapping[str, str] | None = None,
) -> DataFrame:
    """The eight behaviour values of every full window, on its last row.

    Input: rows from :func:`sessionize` with ``dest_ip, dest_port,
    total_bytes, dns_queries, http_uri, tls_sni``. Scalars use frame
    functions; only short string lists are collected per window. Long sessions
    are computed in chunks that overlap by ``size - 1`` rows, so no task sorts
    more than ``chunk_rows`` rows of one session. ``partial`` keeps rows whose
    window is not full yet.

    ``keep`` adds further columns computed over the same frame: each value is
    a column that aggregates (e.g. ``F.max``). ``collect`` adds the values of
    a column in the window's rows, in order, under another name.

    Windows further than a row apart are put together from panes, see
    :func:`pane_behaviour`, unless every row or ``keep`` is asked for.
    """
    keys = list(keys)
    if not partial and not keep and 4 * panes_per_window(size, stride) <= 3 * size:
        return pane_behaviour(df, keys, ts, size, stride, chunk_rows, collect)
    keep = dict(keep or {}) | {n: F.collect_list(c) for n, c in (collect or {}).items()}
    rows = with_halo(df, "session_row", chunk_rows, size - 1)
    w, last, last_deltas = _frames(keys, size)
    at = micros(F.col(ts))
    step = (at - F.lag(at).over(w)) / F.lit(1e6)
    rows = rows.withColumn("__step", step)
    # Deltas count only when positive; the delta into the window's first row
    # belongs to the window before.
    ahead = F.when(F.col("__step") > 0, F.col("__step"))
    rows = rows.withColumns({
        "__n": F.count(F.lit(1)).over(last),
        "window_start": F.first(ts).over(last),
        "window_end": F.col(ts),
        "__mean": F.avg(ahead).over(last_deltas),
        "__std": F.stddev_pop(ahead).over(last_deltas),
        "__span": F.sum(ahead).over(last_deltas),
        "__var": F.var_pop(F.col("total_bytes").cast("double")).over(last),
        "__dest": F.collect_list("dest_ip").over(last),
        "__port": F.collect_list("dest_port").over(last),
        "__dns": F.collect_list("dns_queries").over(last),
        "__uri": F.collect_list(F.nullif(F.col("http_uri"), F.lit(""))).over(last),
        "__sni": F.collect_list(F.nullif(F.col("tls_sni"), F.lit(""))).over(last),
        **{name: agg.over(last) for name, agg in keep.items()},
    })
    wanted = ~F.col("__halo")
    if not partial:
        wanted = wanted & _full(size, stride)
    rows = rows.where(wanted)
    zero = F.lit(0.0)
    minutes = F.greatest(F.coalesce(F.col("__span"), zero), F.lit(1.0)) / 60.0
    values = {
        "beacon_interval_mean": F.coalesce(F.col("__mean"), zero),
        "beacon_interval_std": F.coalesce(F.col("__std"), zero),
        "dst_ip_entropy": lists.entropy(F.col("__dest")),
        "dns_per_min": F.size(F.array_distinct(F.flatten("__dns"))) / minutes,
        "uri_entropy": lists.entropy(F.col("__uri")),
        "same_dst_port_ratio": lists.modal_share(F.col("__port")),
        "tls_sni_reuse": lists.reuse_ratio(F.col("__sni")),
        "payload_size_variance": F.col("__var"),
    }
    rows = rows.withColumns({
        n: F.when(F.col("__n") >= 2, values[n]).otherwise(zero) for n in WINDOW_FEATURES
    })
    rows = rows.withColumn("window_rows", F.col("__n"))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def panes_per_window(size: int, stride: int) -> int:
    """Stretches between the edges of windows, starts or ends, that make up one window."""
    return size // stride if size % stride == 0 else 2 * (size // stride) + 1


def _moments(values: Column) -> Column:
    """Count, mean and summed squared deviation of an array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(n, F.lit(1))
    return lists._bound(mean, lambda m: F.struct(
        n.cast("double").alias("n"), m.alias("m"),
        F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)).alias("q"),
    ))


def _merged_moments(parts: Column) -> Column:
    """Moments of a union from the moments of its parts."""
    def total(body) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda a, p: a + body(p))

    n = total(lambda p: p["n"])
    mean = total(lambda p: p["n"] * p["m"]) / F.greatest(n, F.lit(1.0))
    return lists._bound(mean, lambda m: F.struct(
        n.alias("n"), m.alias("m"),
        total(lambda p: p["q"] + p["n"] * (p["m"] - m) * (p["m"] - m)).alias("q"),
    ))


def pane_behaviour(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    size: int = WINDOW_SIZE,
    stride: int = WINDOW_SIZE,
    chunk_rows: int = MAX_GROUP_ROWS,
    collect: Mapping[str, str] | None = None,
) -> DataFrame:
    """:func:`sliding_behaviour` for windows ``stride`` rows apart, from partial aggregates.

    The edges of all windows cut a session into panes: one per stride where
    the stride divides the size, else two. An aggregate reduces each pane to
    the moments of its sizes and steps, its ends and its short lists, and
    brings its last row along; a window merges its panes. Rows between the
    windows' ends are never framed. Where windows do not overlap, the
    aggregate is all there is.
    """
    keys, rest = list(keys), size % stride
    k = panes_per_window(size, stride)
    place = F.col("session_row") - 1
    block, offset = F.floor(place / F.lit(stride)).cast("long"), F.pmod(place, F.lit(stride))
    late = offset >= rest
    pane = block if rest == 0 else block * 2 + late.cast("long")
    length = F.lit(stride) if rest == 0 else F.when(late, stride - rest).otherwise(rest)
    bytes_ = F.col("total_bytes").cast("double")
    group = [*keys, "session", "__pane"]
    collected = {f"__c{i}": c for i, c in enumerate((collect or {}).values())}
    line = F.struct("session_row", F.col(ts).alias("ts"), micros(F.col(ts)).alias("us"),
                    *[F.col(c).alias(n) for n, c in collected.items()])
    present = lambda c: F.collect_list(F.nullif(F.col(c), F.lit("")))
    panes = df.withColumns({"__pane": pane, "__length": length}).groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"), F.first("__length").alias("__length"),
        F.sort_array(F.collect_list(line)).alias("__lines"),
        F.max_by(F.struct(*df.columns), "session_row").alias("__last"),
        F.struct(F.count(bytes_).cast("double").alias("n"), F.coalesce(F.avg(bytes_), F.lit(0.0)).alias("m"),
                 F.coalesce(F.var_pop(bytes_) * F.count(bytes_), F.lit(0.0)).alias("q")).alias("__sizes"),
        F.collect_list("dest_ip").alias("__dest"), F.collect_list("dest_port").alias("__port"),
        F.collect_list("dns_queries").alias("__dns"), present("http_uri").alias("__uri"),
        present("tls_sni").alias("__sni"),
    ).where(F.col("__n") == F.col("__length"))
    of_lines = lambda name: F.transform("__lines", lambda r: r[name])
    seconds = lambda later, earlier: (later - earlier) / F.lit(1e6)
    ahead = F.filter(F.zip_with(
        F.slice("__lines", F.lit(2), F.size("__lines") - 1), F.slice("__lines", F.lit(1), F.size("__lines") - 1),
        lambda b, a: seconds(b["us"], a["us"]),
    ), lambda d: d > 0)
    part = F.struct(
        F.col("__pane").alias("pane"), _moments(ahead).alias("steps"), F.col("__sizes").alias("sizes"),
        F.get("__lines", F.lit(0))["us"].alias("from"), F.get("__lines", F.size("__lines") - 1)["us"].alias("to"),
        F.get("__lines", F.lit(0))["ts"].alias("start"),
        *[F.col(f"__{c}").alias(c) for c in ("dest", "port", "dns", "uri", "sni")],
        *[of_lines(n).alias(n) for n in collected],
    )
    panes = panes.select(*group, "__last", part.alias("__part"))
    if k == 1:
        rows = panes.withColumn("__parts", F.array("__part"))
    else:
        ranked = with_halo(panes.withColumn("__rank", F.col("__pane") + 1), "__rank", max(chunk_rows, k), k - 1)
        frame = Window.partitionBy(*keys, "session", "__chunk").orderBy("__pane").rowsBetween(1 - k, 0)
        rows = ranked.withColumn("__parts", F.collect_list("__part").over(frame))
        # Windows end with every pane, or with every other one; all their panes are whole.
        ends = F.lit(True) if rest == 0 else F.col("__pane") % 2 == 0
        rows = rows.where(~F.col("__halo") & ends & (F.size("__parts") == k) & (
            F.get("__parts", F.lit(0))["pane"] == F.col("__pane") - (k - 1)
        ))

    def field(name: str) -> Column:
        return F.transform("__parts", lambda p: p[name])

    between = F.filter(F.zip_with(
        F.slice("__parts", F.lit(2), F.lit(k - 1)), F.slice("__parts", F.lit(1), F.lit(k - 1)),
        lambda b, a: seconds(b["from"], a["to"]),
    ), lambda d: d > 0)
    single = F.transform(between, lambda d: F.struct(F.lit(1.0).alias("n"), d.alias("m"), F.lit(0.0).alias("q")))
    rows = rows.withColumns({
        "__steps": _merged_moments(F.concat(field("steps"), single)),
        "__sizes": _merged_moments(field("sizes")),
    })
    zero, steps, sizes = F.lit(0.0), F.col("__steps"), F.col("__sizes")
    minutes = F.greatest(steps["n"] * steps["m"], F.lit(1.0)) / 60.0
    values = {
        "beacon_interval_mean": F.when(steps["n"] > 0, steps["m"]).otherwise(zero),
        "beacon_interval_std": F.when(steps["n"] > 0, F.sqrt(steps["q"] / steps["n"])).otherwise(zero),
        "dst_ip_entropy": lists.entropy(F.flatten(field("dest"))),
        "dns_per_min": F.size(F.array_distinct(F.flatten(F.flatten(field("dns"))))) / minutes,
        "uri_entropy": lists.entropy(F.flatten(field("uri"))),
        "same_dst_port_ratio": lists.modal_share(F.flatten(field("port"))),
        "tls_sni_reuse": lists.reuse_ratio(F.flatten(field("sni"))),
        "payload_size_variance": F.when(sizes["n"] > 0, sizes["q"] / sizes["n"]),
    }
    return rows.select(
        *[F.col("__last")[c].alias(c) for c in df.columns],
        F.get("__parts", F.lit(0))["start"].alias("window_start"), F.col("__last")[ts].alias("window_end"),
        *[F.flatten(field(n)).alias(name) for n, name in zip(collected, collect or {})],
        *[(values[n] if size >= 2 else zero).alias(n) for n in WINDOW_FEATURES],
        F.lit(size).cast("long").alias("window_rows"),
    )


def window_tensor(
    df: DataFrame,
    keys: Sequence[str] = ("src_ip",),
    ts: str = "ts",
    features: str = "features",
    size: int = WINDOW_SIZE,
    stride: int = 1,
    chunk_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Full windows with ``window``: size x (features + 8) as array<array<float>>.

    Every flow of a window repeats the window's eight behaviour values.
    """
    rows = sliding_behaviour(
        df, keys, ts, size, stride,
        collect={"flow_rows": features}, chunk_rows=chunk_rows,
    )
    return stack_window(rows)


def stack_window(df: DataFrame, rows: str = "flow_rows", into: str = "window") -> DataFrame:
    """Append the behaviour values to each collected flow vector."""
    tail = F.array(*[F.col(n).cast("float") for n in WINDOW_FEATURES])
    return df.withColumn(into, F.transform(rows, lambda x: F.concat(x, tail))).drop(rows)


def behaviour_of(df: DataFrame, window: str = "rows") -> DataFrame:
    """The eight behaviour values of a window given as an array of structs.

    The array is in time order; its structs hold ``us, dest_ip, dest_port,
    total_bytes, dns_queries, http_uri, tls_sni``. This is the form a stateful
    stream emits; the values equal those of :func:`sliding_behaviour`.
    """
    def field(name: str) -> Column:
        return F.transform(window, lambda r: r[name])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    n = F.size(window)
    zero = F.lit(0.0)
    df = df.withColumns({
        "__us": field("us"),
        "__bytes": F.transform(window, lambda r: r["total_bytes"].cast("double")),
    })
    steps = F.zip_with(
        F.slice("__us", F.lit(2), F.greatest(n - 1, F.lit(0))),
        F.slice("__us", F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda b, a: (b - a) / F.lit(1e6),
    )
    df = df.withColumn("__steps", F.filter(steps, lambda d: d > 0))
    k = F.size("__steps")
    df = df.withColumn("__mean", F.when(k > 0, total(F.col("__steps")) / k).otherwise(zero))
    some = F.greatest(n, F.lit(1))  # an empty window divides by nothing
    df = df.withColumn("__level", total(F.col("__bytes")) / some)

    def spread(values: str, centre: str) -> Column:
        return total(F.transform(values, lambda x: (x - F.col(centre)) * (x - F.col(centre))))

    names = F.flatten(F.transform(window, lambda r: F.coalesce(
        r["dns_queries"], F.array().cast("array<string>")
    )))
    minutes = F.greatest(total(F.col("__steps")), F.lit(1.0)) / 60.0
    values = {
        "beacon_interval_mean": F.col("__mean"),
        "beacon_interval_std": F.when(k > 0, F.sqrt(spread("__steps", "__mean") / k)).otherwise(zero),
        "dst_ip_entropy": lists.entropy(field("dest_ip")),
        "dns_per_min": F.size(F.array_distinct(names)) / minutes,
        "uri_entropy": lists.entropy(lists.present(field("http_uri"))),
        "same_dst_port_ratio": lists.modal_share(field("dest_port")),
        "tls_sni_reuse": lists.reuse_ratio(lists.present(field("tls_sni"))),
        "payload_size_variance": spread("__bytes", "__level") / some,
    }
    df = df.withColumns({
        m: F.when(n >= 2, values[m]).otherwise(zero) for m in WINDOW_FEATURES
    })
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def attack_classes(df: DataFrame, label: str = "label", benign: int = 0) -> list[int]:
    """The labels that occur, but the benign one: as many as the label scheme has."""
    found = df.select(label).where(F.col(label).isNotNull() & (F.col(label) != benign)).distinct()
    return sorted(r[0] for r in found.collect())


def label_windows(
    df: DataFrame,
    keys: Sequence[str] = ("src_ip",),
    label: str = "label",
    classes: Sequence[int] | None = None,
    benign: int = 0,
    size: int = WINDOW_SIZE,
    stride: int = 1,
    chunk_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Full windows labelled by the majority of their non-benign rows.

    All-benign windows are dropped; among equally frequent classes the
    smallest id wins. ``classes`` defaults to every label in the data; where it
    is given, other labels do not vote.
    """
    if classes is None:
        classes = attack_classes(df, label, benign)
    wanted = sorted(c for c in classes if c != benign)
    if not wanted:
        return df.where(F.lit(False)).withColumn("window_label", F.lit(None).cast("int"))
    rows = with_halo(df, "session_row", chunk_rows, size - 1)
    _, last, _ = _frames(list(keys), size)
    rows = rows.withColumns({
        f"__c{c}": F.count_if(F.col(label) == c).over(last) for c in wanted
    }).where(~F.col("__halo") & _full(size, stride))
    most = F.greatest(*[F.col(f"__c{c}") for c in wanted]) if len(wanted) > 1 else F.col(f"__c{wanted[0]}")
    choice = F.coalesce(*[
        F.when(F.col(f"__c{c}") == most, F.lit(c)) for c in wanted
    ])
    out = rows.where(most > 0).withColumn("window_label", choice)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def tumbling_windows(
    df: DataFrame,
    keys: Sequence[str] = ("src_ip",),
    ts: str = "ts",
    size: int = WINDOW_SIZE,
    **aggregates: Column,
) -> DataFrame:
    """Windows of a buffer that is cleared each time it fills: no overlap.

    A plain aggregation: a session of any length is merged map-side.
    """
    return (
        df.withColumn("window_no", F.floor((F.col("session_row") - 1) / F.lit(size)).cast("long"))
        .groupBy(*keys, "session", "window_no")
        .agg(
            F.count(F.lit(1)).alias("window_rows"),
            F.min(ts).alias("window_start"),
            F.max(ts).alias("window_end"),
            *[c.alias(n) for n, c in aggregates.items()],
        )
        .where(F.col("window_rows") == size)
    )
