"""Scaling, alignment and models against numpy."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowloom.operators.align import CoralAdapter, FeaturewiseAdapter, Scaler, coral_loss, covariance
from flowloom.operators.metrics import class_weights, grid, thresholds_met
from flowloom.operators.scoring import argmax, importances, score_flows, train_trees


@pytest.fixture(scope="module")
def domains(spark):
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(4, 4))
    xs, xt = rng.normal(size=(300, 4)) @ mix + 3, rng.normal(size=(200, 4)) * [1, 4, 0.5, 2] - 1
    return xs, xt, *[
        spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, features array<double>")
        for x in (xs, xt)
    ]


def matrix(df, col="aligned"):
    return np.array([r[0] for r in df.orderBy("id").select(col).collect()])


def test_scaler(domains, spark):
    xs, _, source, _ = domains
    scaler = Scaler.fit(source)
    assert np.allclose(scaler.mean, xs.mean(0)) and np.allclose(scaler.scale, xs.std(0))
    flat = source.withColumn("features", F.concat("features", F.array(F.lit(5.0))))
    assert Scaler.fit(flat).scale[-1] == 1.0
    assert np.allclose(matrix(scaler.apply(source), "scaled"), (xs - xs.mean(0)) / xs.std(0))
    again = Scaler.from_df(scaler.to_df(spark))
    assert np.array_equal(again.scale, scaler.scale)


def test_covariance_and_loss(domains):
    xs, xt, source, target = domains
    assert np.allclose(covariance(source.repartition(5)), np.cov(xs.T))
    want = np.sum((np.cov(xs.T) - np.cov(xt.T)) ** 2)
    assert coral_loss(source, target) == pytest.approx(want)
    assert coral_loss(source, target, normalised=True, weight=2.0) == pytest.approx(2 * want / 64)


def test_coral(domains, spark, tmp_path):
    xs, xt, source, target = domains
    adapter = CoralAdapter.fit(source, target)
    zs, zt = (xs - xs.mean(0)) / xs.std(0), (xt - xs.mean(0)) / xs.std(0)
    moved = matrix(adapter.transform_source(source))
    # Aligned source rows have the target's mean and covariance.
    assert np.allclose(moved.mean(0), zt.mean(0)) and np.allclose(np.cov(moved.T), np.cov(zt.T), atol=1e-2)
    back = matrix(adapter.transform_target(target))
    assert np.allclose(back.mean(0), zs.mean(0)) and np.allclose(np.cov(back.T), np.cov(zs.T), atol=1e-2)
    raw = matrix(adapter.transform_target(target, raw_units=True))
    assert np.allclose(raw, back * xs.std(0) + xs.mean(0))
    # Round trip through both directions.
    trip = adapter.transform_source(source, into="there", raw_units=True)
    home = matrix(adapter.transform_target(trip, "there", "home", raw_units=True), "home")
    assert np.allclose(home, xs)
    q = adapter.quality(spark).first()
    eye = 1e-5 * np.eye(4)
    assert q["frobenius_distance"] == pytest.approx(np.linalg.norm(np.cov(zs.T) - np.cov(zt.T)))
    assert q["condition_number_target"] == pytest.approx(np.linalg.cond(np.cov(zt.T) + eye))
    adapter.save(spark, str(tmp_path / "a"))
    assert np.allclose(CoralAdapter.load(spark, str(tmp_path / "a")).matrix, adapter.matrix)


def test_coral_fails_fast(domains):
    _, _, source, target = domains
    with pytest.raises(ValueError):
        CoralAdapter.fit(source, target.withColumn("features", F.slice("features", 1, 3)))
    adapter = CoralAdapter.fit(source, target)
    adapter.target_mean = adapter.target_mean * np.nan
    with pytest.raises(ValueError):
        adapter.check()


def test_variants(domains):
    xs, xt, source, target = domains
    union = np.vstack([xs, xt])
    same = CoralAdapter.fit(source, target, scale_on="union", identity_target=True)
    assert np.allclose(matrix(same.transform_target(target)), (xt - union.mean(0)) / union.std(0))
    want = {
        "standardize": (xt - xt.mean(0)) / xt.std(0), "mean_only": xt - xt.mean(0) + xs.mean(0),
        "rescale": (xt - xt.mean(0)) / xt.std(0) * xs.std(0) + xs.mean(0),
    }
    for mode, value in want.items():
        got = FeaturewiseAdapter.fit(source, target, mode=mode).transform_target(target)
        assert np.allclose(matrix(got), value)


@pytest.mark.parametrize("boosted", [False, True])
def test_training(spark, boosted):
    df = spark.range(240).select(
        F.array((F.col("id") % 3) * 2.0, F.col("id") % 5 * 1.0).alias("features"), (F.col("id") % 3).alias("label"),
        (F.col("id") % 4 == 0).alias("held"),
    )
    model = train_trees(df, boosted=boosted, trees=4, depth=3, validation="held" if boosted else None)
    scored = score_flows(df, model)
    assert scored.where(argmax(F.col("probs")) == F.col("label")).count() == 240
    total = scored.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)).first()[0]
    assert total == pytest.approx(1.0)
    if not boosted:
        top = importances(model, ["signal", "noise"], spark)
        assert dict(rows(top))["signal"] > 0.9


def test_weights_and_grid(spark):
    df = spark.sql("SELECT * FROM VALUES (1), (1), (1), (2) AS t(label)")
    assert rows(class_weights(df, classes=[1, 2, 3]), "label", "weight") == [(1, 4 / 6), (2, 2.0), (3, 1.0)]
    limits = grid(50, 99)
    scores = sorted(set(limits + [0.0, 0.499999, 0.505, 0.99, 1.0] + [t - 1e-12 for t in limits] + [t + 1e-12 for t in limits]))
    got = spark.createDataFrame([(s,) for s in scores], "s double").select("s", thresholds_met(F.col("s"), limits).alias("m"))
    assert all(r["m"] == sum(r["s"] >= t for t in limits) for r in got.collect())
    odd = [0.1, 0.5, 0.51]
    got = spark.createDataFrame([(s,) for s in scores], "s double").select("s", thresholds_met(F.col("s"), odd).alias("m"))
    assert all(r["m"] == sum(r["s"] >= t for t in odd) for r in got.collect())


def test_moments_merge_in_any_cut(spark):
    """Means far from zero, a constant column, one row, empty tasks: as numpy has it."""
    from flowloom.operators.align import Moments, moments

    rng = np.random.default_rng(2)
    x = np.c_[rng.normal(1e6, 1, 300), np.full(300, 0.1), rng.integers(0, 3, 300).astype(float)]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>")
    for parts in (1, 7, 400):
        m = moments(df.repartition(parts))
        assert m.n == 300 and np.allclose(m.mean, x.mean(axis=0)) and m.deviation[1] == 0 and m.scaler().scale[1] == 1
        assert np.allclose(m.covariance(), np.cov(x.T), rtol=1e-9, atol=1e-9)
    halves = Moments.of(x[:1]).merged(Moments.of(x[1:]))
    assert np.allclose(halves.gram, Moments.of(x).gram) and np.allclose(halves.mean, x.mean(axis=0))
    with pytest.raises(ValueError, match="no rows"):
        moments(df.limit(0))


def test_one_scan_a_side(spark, tmp_path):
    """A fit reads each side once."""
    from flowloom.operators.align import CoralAdapter

    rng = np.random.default_rng(4)
    for side in "st":
        spark.createDataFrame([(rng.normal(size=3).tolist(),) for _ in range(50)], "features array<double>").write.parquet(f"{tmp_path}/{side}")
    seen = []
    source, target = (spark.read.parquet(f"{tmp_path}/{side}") for side in "st")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("coral-fit", "fit")
    CoralAdapter.fit(source, target)
    seen = tracker.getJobIdsForGroup("coral-fit")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 2 <= len(seen) <= 4  # with adaptive execution, a job per shuffle and one for its result
