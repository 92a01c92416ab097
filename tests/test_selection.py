"""Order statistics and merged spans, with every road forced, against plain Python."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowloom.operators.labeling import interval_label, merged_spans
from flowloom.operators.sampling import first_n, ordered_split, slice_rows
from flowloom.operators.selection import order_codes, rows_between, value_cuts


@pytest.mark.parametrize("max_rows", [3, 40, 10**6])
def test_slices_are_exact_on_a_dominant_key(spark, max_rows):
    """A key with most rows, one of a single row, a null key; long texts with one beginning, nulls, ties."""
    rng = random.Random(4)
    table = [("a" if i % 10 else "b", f"file:///data/part-{rng.randrange(40):05d}", rng.randrange(-5, 5), i) for i in range(700)]
    table += [("c", None, 1, 900), (None, "x", None, 901), (None, "x", 2, 902)]
    df = spark.createDataFrame(table, "g string, f string, n int, i int").withColumn("o", F.struct("f", "n")).repartition(6)
    order = lambda t: ((t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or 0), t[3])
    got = slice_rows(df, 5, 30, ["o", "i"], ["g"], max_rows)
    want = []
    for g in ("a", "b", "c", None):
        want += [t[3] for t in sorted([t for t in table if t[0] == g], key=order)[5:35]]
    assert rows(got, "i") == sorted((i,) for i in want)
    assert rows(first_n(df, [], 7, ["o", "i"], max_rows), "i") == sorted((t[3],) for t in sorted(table, key=order)[:7])


def test_ties_at_a_cut_keep_the_size(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 20).alias("n"), "id")
    got = slice_rows(df, 5, 12, ["n"], ["g"], max_rows=4)
    assert rows(got.groupBy("g").count()) == [(0, 12), (1, 12)]
    assert {r["n"] for r in got.collect()} == {0, 1}
    cuts = value_cuts(df, ["g"], ["n"], {"x": lambda n: n - 1, "none": lambda n: F.lit(0), "past": lambda n: n + 9}, 4)
    assert rows(cuts, "g", "name", "cut.n", "ties", "taken") == [
        (0, "past", 4, 10, 10), (0, "x", 4, 10, 9), (1, "past", 4, 10, 10), (1, "x", 4, 10, 9)]


def test_orders_of_many_types(spark):
    """Numbers beyond exact doubles, infinite and missing ones, dates, times, booleans, empty and long texts."""
    day = dt.date(2024, 1, 1)
    table = [(2**62 + i, float(x), day + dt.timedelta(days=i), i % 2 == 0, "ab" * (i % 4) + chr(300 + i))
             for i, x in enumerate([1.5, float("inf"), -1e308, float("nan"), 0.0, -0.5, float("-inf"), 1e308])]
    table += [(None, None, None, None, None), (2**62, None, day, True, "")]
    df = spark.createDataFrame(table, "a long, b double, c date, d boolean, e string").withColumn("t", F.col("c").cast("timestamp_ntz"))
    for order in (["a", "b"], ["b", "a"], ["d", "a"], ["e", "a"], ["t", "a"]):
        want = [tuple(r) for r in df.orderBy(*order).limit(4).select("a", "e").collect()]
        key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
        got = [tuple(r) for r in first_n(df, [], 4, order, max_rows=1).select("a", "e").collect()]
        assert sorted(got, key=key) == sorted(want, key=key), order
    # Two pieces and the length; nothing behind a type without exact numbers.
    assert len(order_codes(df, ["e"])) == 3
    assert len(order_codes(df.withColumn("a", F.col("a").cast("decimal(30,2)")), ["a", "e"])) == 1


def test_selection_shuffles_no_wide_row(spark):
    df = spark.range(5000).select("id", F.repeat(F.lit("x"), 50).alias("wide"))
    out = rows_between(df, [], ["id"], lambda n: F.lit(10), lambda n: F.lit(4000), max_rows=100)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert out.count() == 3990 and out.agg(F.min("id"), F.max("id")).first() == (10, 3999)
    split = ordered_split(df, 0.3, ["id"], max_rows=50)
    assert rows(split.groupBy("part").count()) == [("train", 1500), ("val", 3500)]
    assert first_n(df.limit(0), [], 3, ["id"]).count() == 0 and slice_rows(df, 6000, 5, ["id"]).count() == 0


def spans_of(windows):
    out = []
    for a, b in sorted(w for w in windows if None not in w and w[0] <= w[1]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


@pytest.mark.parametrize("max_rows", [5, 10**6])
def test_spans_and_labels(spark, max_rows):
    """Nested, touching, equal, single-instant, reversed and open windows; a busy bucket; null times and addresses."""
    rng = random.Random(6)
    hour = 3_600_000_000
    windows = [(a, a + rng.randrange(0, 3 * hour)) for a in (rng.randrange(0, 60 * hour) for _ in range(25))]
    windows += [(70 * hour, 70 * hour), (70 * hour + 1, 70 * hour + 5), (9, 3), (None, 5), (5, None), (71 * hour, 95 * hour), *[(hour, hour + 9)] * 3]
    at = lambda c: F.timestamp_micros(c)
    frame = spark.createDataFrame(windows, "a long, b long").select(at(F.col("a")).alias("start"), at(F.col("b")).alias("end"))
    spans = spans_of(windows)
    assert rows(merged_spans(frame, max_rows=max_rows), "a", "b") == spans
    times = [None, *[x + d for s in spans for x in s for d in (-1, 0, 1)], *range(0, 2 * hour, hour // 40), -5]
    flows = [(i, "v" if i % 3 else None, "w" if i % 2 else "v", t) for i, t in enumerate(times)]
    df = spark.createDataFrame(flows, "i int, src_ip string, dest_ip string, us long").withColumn("ts", at(F.col("us")))
    victims = spark.createDataFrame([("v",), ("v",), (None,)], "ip string")
    got = interval_label(df, frame, victims, max_rows=max_rows)
    want = [(i, int("v" in (s, d) and t is not None and any(a <= t <= b for a, b in spans))) for i, s, d, t in flows]
    assert rows(got, "i", "label") == want and 0 < sum(w[1] for w in want) < len(want)
    assert rows(interval_label(df, frame.limit(0), victims).select("label").distinct()) == [(0,)]
