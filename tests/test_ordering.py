"""The heavy-key road gives the same rows as the plain windows."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from flowloom.operators.enrich import enrich_flows
from flowloom.operators.features import window_meta
from flowloom.operators.labeling import clock_offset, folded_label, nearest_label
from flowloom.operators.metrics import latency_summary, pr_auc, pr_curve
from flowloom.operators.ordering import (
    hash_cuts, hash_position, hash_rank, hash_running_total, neighbours, row_numbers, running_totals,
    split_heavy, with_halo,
)
from flowloom.operators.sampling import (
    first_n, ordered_split, sample_per_class, slice_rows, stratified_split, window_quota,
)
from flowloom.operators.windows import label_windows, sessionize, sliding_behaviour
from flowloom.plans.events_eve import events_as_eve
from flowloom.schema import WINDOW_FEATURES

SMALL = 25  # rows per key above which a key counts as heavy


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; times repeat."""
    n = 1200
    return spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 1, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 61).cast("string"))).alias("key"),
        (F.floor(F.col("id") / 7) * 40 + F.when(F.col("id") > 700, 4000).otherwise(0)).alias("t"),
        (F.col("id") * 7919 % 13).alias("v"),
    ).withColumn("ts", F.timestamp_seconds("t"))


def test_split_heavy_keeps_every_row(skewed):
    light, heavy = split_heavy(skewed, ["key"], SMALL)
    assert light.count() + heavy.count() == skewed.count()
    assert rows(heavy.select("key").distinct()) == [("hot",)]
    assert split_heavy(skewed, ["key"], 10_000)[1] is None


def test_row_numbers(skewed):
    order = [F.col("t").desc(), F.col("seq")]
    plain = row_numbers(skewed, ["key"], order, total="n")
    heavy = row_numbers(skewed, ["key"], order, max_rows=SMALL, total="n")
    assert rows(plain, "seq", "rn", "n") == rows(heavy, "seq", "rn", "n")


def test_row_numbers_without_key(skewed):
    got = row_numbers(skewed, [], [F.col("seq")], max_rows=SMALL)
    assert all(r["rn"] == r["seq"] + 1 for r in got.collect())


def test_running_totals(skewed):
    args = (["key"], [F.col("t"), F.col("seq")], {"s": F.col("v"), "c": F.lit(1)})
    cols = ("seq", "s", "c", "s_all", "c_all")
    assert rows(running_totals(skewed, *args), *cols) == rows(
        running_totals(skewed, *args, max_rows=SMALL), *cols
    )


def test_neighbours(skewed):
    marked = skewed.withColumn("m", F.when(F.col("v") < 2, F.col("seq")))
    args = (["key"], ["t", "seq"], "m")
    assert sorted(map(str, neighbours(marked, *args).select("seq", "left", "right").collect())) == sorted(
        map(str, neighbours(marked, *args, max_rows=SMALL).select("seq", "left", "right").collect())
    )


def test_hash_rank_is_a_full_ranking(skewed):
    placed = skewed.withColumn("p", hash_position("seq"))
    got = hash_rank(placed, ["key"], "p", ["seq"], total="n")
    want = placed.withColumn(
        "rn", F.row_number().over(Window.partitionBy("key").orderBy("p", "seq")).cast("long")
    ).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    assert rows(got, "seq", "rn", "n") == rows(want, "seq", "rn", "n")


def test_hash_cuts_split_where_ranks_do(skewed):
    placed = skewed.withColumn("p", hash_position("seq"))
    ranked = hash_rank(placed, ["key"], "p", ["seq"], total="n")
    cuts = hash_cuts(placed, ["key"], "p", ["seq"], {
        "third": lambda n: F.round(n / 3), "nine": lambda n: F.lit(9), "none": lambda n: F.lit(0),
    })
    got = {r["key"]: r for r in cuts.collect()}
    for r in ranked.collect():
        at = (r["p"], r["seq"])
        cut = got[r["key"]]
        third = int(r["n"] / 3 + 0.5)
        assert (r["rn"] <= third) == (cut["third"] is not None and at <= tuple(cut["third"]))
        assert (r["rn"] <= 9) == (at <= tuple(cut["nine"]))
        assert cut["none"] is None


def test_samples_and_splits(skewed):
    known = skewed.dropna()
    counts = dict(known.groupBy("key").count().collect())
    sample = sample_per_class(known, "key", 12, ["seq"])
    assert dict(sample.groupBy("key").count().collect()) == {k: min(12, n) for k, n in counts.items()}
    again = sample_per_class(known.repartition(5), "key", 12, ["seq"])
    assert rows(sample, "seq") == rows(again, "seq")
    split = stratified_split(known, "key", {"a": 0.7, "b": 0.15, "c": 0.15}, ["seq"])
    hot = dict(split.where("key = 'hot'").groupBy("part").count().collect())
    assert hot == {"a": 280, "b": 60, "c": 60} and split.count() == known.count()
    half = ordered_split(known, 0.5, ["seq"], max_rows=SMALL)
    assert half.where("part = 'train'").count() == known.count() // 2
    assert half.where("part = 'train'").agg(F.max("seq")).first()[0] < half.where(
        "part = 'val'").agg(F.min("seq")).first()[0]


def test_first_rows(skewed):
    want = rows(row_numbers(skewed, ["key"], [F.col("t").desc(), F.col("seq")]).where("rn between 4 and 30"), "seq")
    down = skewed.withColumn("d", -F.col("t"))
    for parts in (1, 7):
        got = slice_rows(down.repartition(parts), 3, 27, ["d", "seq"], ["key"], 40)
        assert rows(got, "seq") == want
    assert first_n(skewed, [], 10, ["seq"]).count() == 10


def test_hash_running_total(skewed):
    placed = skewed.withColumn("p", hash_position("seq"))
    got = hash_running_total(placed, ["key"], "p", ["seq"], "v", "s")
    w = Window.partitionBy("key").orderBy("p", "seq").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got, "seq", "s") == rows(placed.withColumn("s", F.sum("v").over(w)), "seq", "s")


def test_halo_repeats_only_chunk_tails(skewed):
    ranked = row_numbers(skewed, [], [F.col("seq")])
    out = with_halo(ranked, "rn", 100, 7)
    assert out.where("not __halo").count() == 1200
    assert out.where("__halo").count() == 12 * 7
    with pytest.raises(ValueError):
        with_halo(ranked, "rn", 5, 5)


def test_sessionize(skewed):
    def run(n):
        return rows(sessionize(skewed, ["key"], "ts", ["seq"], 300, n), "seq", "session", "session_row")

    assert run(SMALL) == run(10_000)
    assert max(r[1] for r in run(SMALL)) >= 1


def test_enrichment(spark):
    base = events_as_eve(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    hot = base.withColumn("flow_id", F.when(F.col("seq") % 3 == 0, 7).otherwise(F.col("flow_id")))
    cols = ["seq", *[F.to_json(c).alias(c) for c in ("enr_http", "enr_tls", "enr_dns")]]

    def run(n):
        return sorted(map(str, enrich_flows(hot, order=["seq"], max_rows=n).select(*cols).collect()))

    assert run(SMALL) == run(10_000)
    assert len(run(SMALL)) == hot.where("event_type = 'flow'").count()


def test_behaviour_and_labels_in_chunks(spark):
    base = events_as_eve(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    one = enrich_flows(base, order=["seq"]).withColumn(
        "src_ip", F.when(F.col("seq") % 2 == 0, "hot").otherwise(F.col("src_ip"))
    ).withColumn("label", F.col("k") % 4)
    got = {}
    for n in (SMALL, 10_000):
        ready = sessionize(window_meta(one), ["src_ip"], "ts", ["seq"], 864_000, n)
        out = sliding_behaviour(ready, size=8, stride=2, chunk_rows=n).select(
            "seq", *[F.round(c, 6).alias(c) for c in WINDOW_FEATURES]
        )
        got[n] = rows(out), rows(label_windows(ready, size=8, chunk_rows=n), "seq", "window_label")
    assert got[SMALL] == got[10_000]
    assert len(got[SMALL][0]) > 50


@pytest.mark.parametrize("join", [nearest_label, folded_label])
def test_label_joins(skewed, join):
    flows = skewed.dropna()
    labels = skewed.where("v < 4").withColumn("label", F.concat(F.lit("L"), F.col("seq").cast("string")))
    out = [
        sorted(map(str, join(flows, labels, ["key"], max_rows=n).collect())) for n in (SMALL, 10_000)
    ]
    assert out[0] == out[1]


def test_clock_offset(skewed):
    flows = skewed.dropna().withColumn("scenario", F.lit("a"))
    labels = flows.withColumn("ts", F.timestamp_seconds(F.col("t") - 3600))
    out = [rows(clock_offset(flows, labels, ["key"], max_rows=n)) for n in (SMALL, 10_000)]
    assert out[0] == out[1]
    unique = clock_offset(flows, labels, ["seq"], max_rows=SMALL)
    assert rows(unique) == [("a", flows.count(), 3600.0)]


def test_curves(skewed):
    scored = skewed.withColumn("score", F.col("seq") / 1200.0)
    out = [rows(pr_curve(scored, F.col("v") < 5, "score", n)) for n in (SMALL, 10_000)]
    assert out[0] == out[1]
    auc = [pr_auc(pr_curve(scored, F.col("v") < 5, "score", n)).first()[0] for n in (SMALL, 10_000)]
    assert auc[0] == pytest.approx(auc[1])
    lat = [rows(latency_summary(scored, "score", max_rows=n)) for n in (SMALL, 10_000)]
    assert lat[0] == lat[1]
    assert lat[0][0][3] == pytest.approx(599.5 / 1200)


def test_quota_never_exceeded(skewed):
    windows = skewed.dropna().withColumn("label", (F.col("v") % 3).cast("int"))
    out = [
        window_quota(windows, "key", "label", 90, ["seq"], max_rows=n) for n in (SMALL, 10_000)
    ]
    assert rows(out[0]) == rows(out[1])
    assert out[0].count() <= 3 * 90


def test_heavy_keys_are_found_in_a_sample(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("key"), F.col("id").alias("seq")
    )
    light, heavy = split_heavy(df, ["key"], 5_000)
    assert heavy.count() == 20_000 and light.count() == 40_000
    got = row_numbers(df, ["key"], [F.col("seq")], max_rows=5_000).where("key = -1")
    assert got.where(F.col("rn") != F.col("seq") / 3 + 1).count() == 0


def test_clock_offset_of_short_and_long_keys(spark):
    """Keys with few and with many label times, null keys among them, fall into the same bins as all pairs."""
    flows = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("key"),
        F.timestamp_micros(F.col("id") * 7_654_321 % 3_000_000_000).alias("ts"), F.lit("a").alias("scenario"))
    labels = flows.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    pairs = [(f.ts - e.ts).total_seconds() for f in flows.collect() for e in labels.collect() if f.key == e.key]
    lo, hi = min(pairs), max(pairs)
    counts = np.histogram(pairs, 100, (lo, hi))[0]
    centre = lo + (hi - lo) / 100 * (int(counts.argmax()) + 0.5)
    centre = round(centre / 3600) * 3600 if abs(centre - round(centre / 3600) * 3600) < 10 else centre
    got = clock_offset(flows, labels, ["key"])
    assert rows(got.select("scenario", "pairs", F.round("offset_s", 3))) == [("a", len(pairs), round(centre, 3))]
