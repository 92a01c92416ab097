"""The trained window model: held-out windows, saving, and its place in detection."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators.scoring import WindowModel, pooled_window, train_window_model


@pytest.fixture(scope="module")
def windows(spark):
    """Windows of four rows of three features; two of them tell the class, one is constant."""
    def row(i):
        noise = F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 2000.0
        side = F.pmod("id", F.lit(3))
        return F.array((side == 1).cast("double") * 3 + noise, (side == 2).cast("double") * i + noise, F.lit(7.0)).cast("array<float>")

    df = spark.range(240).select("id", F.array(*[row(i) for i in range(4)]).alias("window"), (F.pmod("id", F.lit(3)) * 2 + 1).cast("int").alias("label"))
    return df.cache()


@pytest.mark.parametrize("hidden", [(), (5,)])
def test_held_out_windows(spark, windows, tmp_path, hidden):
    train, held = windows.where("id < 160"), windows.where("id >= 160")
    model = train_window_model(train.unionByName(train.limit(1).withColumn("label", F.lit(None).cast("int"))), hidden=hidden)
    assert model.classes == [1, 3, 5] and len(model.scaler.mean) == 9
    told = model.predict(held)
    assert told.where("predicted = label").count() == held.count() == 80 and told.columns == [*held.columns, "predicted"]
    scored = model.score(held)
    assert scored.where(F.abs(F.aggregate("window_probs", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    model.save(spark, f"{tmp_path}/m")
    again = WindowModel.load(spark, f"{tmp_path}/m")
    assert again.classes == model.classes and again.parts == model.parts
    assert again.predict(held).where("predicted = label").count() == 80


def test_pools(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 2.0]],)], "window array<array<float>>")
    assert pooled_window(df).first()["pooled"] == [2.0, 2.0]
    assert pooled_window(df, parts=("last", "deviation", "mean")).first()["pooled"] == [3.0, 2.0, 1.0, 0.0, 2.0, 2.0]
    with pytest.raises(ValueError, match="median"):
        pooled_window(df, parts=("median",))


def test_one_class_is_refused(windows):
    with pytest.raises(ValueError, match="two classes"):
        train_window_model(windows.where("label = 1"))


def test_detection_with_a_trained_model(spark, sf_dir):
    from flowloom.catalog.alerts import THRESHOLD, demo_score
    from flowloom.plans.detect import described_flows, detect
    from flowloom.plans.events_eve import events_as_eve
    from flowloom.operators.windows import sessionize, window_tensor

    eve = events_as_eve(spark.read.parquet(f"{sf_dir}/events.parquet"))
    gap = 40 * 86_400
    rows = sessionize(described_flows(eve), ["src_ip"], "timestamp", ["seq"], gap)
    ready = window_tensor(rows, ts="timestamp", size=5).select("window", F.pmod("seq", F.lit(3)).cast("int").alias("label"))
    model = train_window_model(ready, parts=("mean",), iterations=20)
    out = detect(eve, demo_score, model.score, threshold=THRESHOLD, size=5, gap_s=gap, with_window=True)
    stages = {r["stage"]: r["n"] for r in out.groupBy("ai.stage").agg(F.count("*").alias("n")).collect()}
    assert set(stages) == {"xgb_only", "xgb+lstm"} and min(stages.values()) > 0


def test_pooling_of_uneven_windows(spark):
    """Windows of one shape are pooled together, others one by one, with the same meaning."""
    even = [(1, [[1.0, 2.0], [3.0, 6.0]]), (2, [[0.0, 0.0], [4.0, 8.0]])]
    odd = [(3, [[1.0, None], [3.0, 6.0]]), (4, None), (5, [[5.0]])]
    got = {}
    for part in (even, odd):
        df = spark.createDataFrame(part, "id int, window array<array<float>>").coalesce(1)
        pooled = pooled_window(df, parts=("mean", "deviation", "last"))
        assert "mapinarrow" in pooled._jdf.queryExecution().toString().lower()  # not an expression per feature
        got |= {r.id: r.pooled for r in pooled.collect()}
    assert got == {1: [2.0, 4.0, 1.0, 2.0, 3.0, 6.0], 2: [2.0, 4.0, 2.0, 4.0, 4.0, 8.0],
                   3: [2.0, None, 1.0, None, 3.0, 6.0], 4: None, 5: [5.0, 0.0, 5.0]}
