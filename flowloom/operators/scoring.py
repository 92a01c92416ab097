"""Decisions on class probabilities, alert records, and model training."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, LogisticRegressionModel,
    MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..schema import (
    DEFAULT_THRESHOLD, FLOW_CLASSES, WINDOW_CLASSES, WINDOW_CONFIDENCE,
)
from ..session import shared_dir
from .align import Scaler
from .labeling import class_names
from .metrics import attach_weights, class_report, class_weights, report_summary

# Alert vocabulary.
GENERIC = "Generic Attack"
FAST_LABEL = "DoS/DDoS"
FAST_CLASSES = (1, 2)
EVENT_TYPE = "ai_alert_hybrid"
PROB_EVENT_TYPE = "ai_alert_v6"
STAGE_FLOW, STAGE_WINDOW = "xgb_only", "xgb+lstm"


def argmax(probs: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def decide(
    df: DataFrame, probs: str = "probs", threshold: float = DEFAULT_THRESHOLD,
    classes: Mapping[int, str] = FLOW_CLASSES, keep_benign: bool = False,
) -> DataFrame:
    """Add ``attack_prob``, ``xgb_class``, ``xgb_label``; drop what is not an alert.

    A row is dropped when its attack probability is below the threshold or, for
    a multiclass model, when benign is its most likely class. Models with two
    classes name every attack generically. ``keep_benign`` keeps all rows and
    adds the decision as ``is_alert``.
    """
    multiclass = len(classes) > 2
    decision = F.struct(
        (1.0 - F.get(F.col(probs), F.lit(0))).alias("attack_prob"),
        argmax(F.col(probs)).alias("xgb_class"),
    )

    def alert(d: Column) -> Column:
        over = d["attack_prob"] >= threshold
        return over & (d["xgb_class"] != 0) if multiclass else over

    if keep_benign:
        out = df.withColumn("__d", decision).withColumn("is_alert", alert(F.col("__d")))
    else:
        # A plain filter would be pushed below the model and make it run twice,
        # once for the predicate; a generator with no or one row is not pushed.
        out = df.withColumn("__d", F.explode(F.filter(F.array(decision), alert)))
    out = out.withColumns({
        "attack_prob": F.col("__d.attack_prob"), "xgb_class": F.col("__d.xgb_class"),
    }).drop("__d")
    if multiclass:
        return class_names(out, classes, "xgb_class", "xgb_label")
    return out.withColumn("xgb_label", F.lit(GENERIC))


def fast_path(multiclass: bool = True, classes: Sequence[int] = FAST_CLASSES) -> Column:
    """True for classes that alert at once, without the window stage."""
    return F.col("xgb_class").isin(*classes) if multiclass else F.lit(False)


def gate_window(
    df: DataFrame, probs: str = "window_probs", confidence: float = WINDOW_CONFIDENCE,
    classes: Mapping[int, str] = WINDOW_CLASSES, missing: str = "Unknown",
) -> DataFrame:
    """Add ``window_label`` and ``window_confidence``; unsure windows are generic."""
    best = F.array_max(F.col(probs))
    named = class_names(
        df.withColumn("__k", argmax(F.col(probs))), classes, "__k", "__name", missing
    )
    return named.withColumns({
        "window_label": F.when(best < confidence, GENERIC).otherwise(F.col("__name")),
        "window_confidence": F.round(best, 4),
    }).drop("__k", "__name")


def alert_record(
    label: Column, confidence: Column, stage: Column, meta: str = "meta",
    event_type: str = EVENT_TYPE, probs: Column | None = None,
) -> list[Column]:
    """Columns of a nested alert built from the flow description.

    With ``probs`` (a map) the nested part carries the class probabilities
    instead of the stage.
    """
    m = F.col(meta)
    ai = [label.alias("label"), confidence.alias("confidence")]
    if probs is None:
        ai += [
            stage.alias("stage"),
            F.col("xgb_class").alias("xgb_class"), F.col("xgb_label").alias("xgb_label"),
        ]
    else:
        ai.append(probs.alias("class_probs"))
    ai += [m["duration_s"].alias("duration_s"), m["total_bytes"].alias("total_bytes"),
           m["byte_rate"].alias("byte_rate")]
    flat = ["src_ip", "dest_ip", "src_port", "dest_port", "proto", "app_proto", "flow_id"]
    return [
        m["timestamp"].alias("timestamp"), F.lit(event_type).alias("event_type"),
        *[m[c].alias(c) for c in flat], F.struct(*ai).alias("ai"),
    ]


def class_probs(probs: str, classes: Mapping[int, str] = FLOW_CLASSES) -> Column:
    """Class name -> rounded probability."""
    return F.map_from_arrays(
        F.array(*[F.lit(classes[i]) for i in sorted(classes)]),
        F.transform(F.col(probs), lambda p: F.round(p, 4)),
    )


def prob_alerts(
    df: DataFrame, probs: str = "probs", threshold: float = DEFAULT_THRESHOLD,
    classes: Mapping[int, str] = FLOW_CLASSES,
) -> DataFrame:
    """Single-stage alerts with the full probability map.

    The threshold alone decides here; a benign top class does not suppress.
    """
    scored = class_names(
        df.withColumns({
            "attack_prob": 1.0 - F.get(F.col(probs), F.lit(0)), "xgb_class": argmax(F.col(probs)),
        }), classes, "xgb_class", "xgb_label",
    ).where(F.col("attack_prob") >= threshold)
    return scored.select(*alert_record(
        F.col("xgb_label"), F.round("attack_prob", 4), F.lit(None),
        event_type=PROB_EVENT_TYPE, probs=class_probs(probs, classes),
    ))


def window_alarms(df: DataFrame, probs: str = "window_probs",
                  confidence: float = WINDOW_CONFIDENCE,
                  classes: Mapping[int, str] = WINDOW_CLASSES) -> DataFrame:
    """Flat alarm per window: source, class, confidence, start and end."""
    gated = gate_window(df, probs, confidence, classes, missing=GENERIC)
    return gated.select(
        "src_ip", F.col("window_label").alias("class"),
        F.col("window_confidence").alias("confidence"), "window_start", "window_end",
    )


def as_json(df: DataFrame, into: str = "value") -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(into))


# Models ---------------------------------------------------------------------


def train_trees(
    df: DataFrame, features: str = "features", label: str = "label", weighted: bool = True,
    boosted: bool = False, validation: str | None = None, trees: int = 50, depth: int = 8,
    seed: int = 42, **options,
) -> Model:
    """Multiclass tree ensemble on an array column.

    Random forest by default; ``boosted`` trains one boosted binary model per
    class, which can stop early on rows flagged by ``validation``. ``weighted``
    balances the classes.
    """
    columns = [F.col(label).cast("double").alias(label), array_to_vector(F.col(features)).alias("vec")]
    if validation:
        columns.append(F.col(validation))
    data = df.select(*columns)
    weight = None
    if weighted:
        weight = "weight"
        data = attach_weights(data, class_weights(data, label), label, weight)
    common = {"featuresCol": "vec", "labelCol": label, "maxDepth": depth, "subsamplingRate": 0.8,
              "seed": seed, **options}
    if not boosted:
        model = RandomForestClassifier(numTrees=trees, **common)
        if weight:
            model.setWeightCol(weight)
        return model.fit(data)
    binary = GBTClassifier(maxIter=trees, stepSize=0.05, **common)
    if validation:
        binary.setValidationIndicatorCol(validation)
    if weight:
        binary.setWeightCol(weight)
    every = OneVsRest(classifier=binary, featuresCol="vec", labelCol=label)
    if weight:
        every.setWeightCol(weight)
    return every.fit(data)


def score_flows(df: DataFrame, model: Model | PipelineModel, features: str = "features",
                into: str = "probs") -> DataFrame:
    """Class probabilities of a fitted model as ``array<double>``."""
    vectored = df.withColumn("vec", array_to_vector(F.col(features)))
    scored = model.transform(vectored)
    if "probability" in scored.columns:
        probs = vector_to_array("probability")
    else:
        # One-vs-rest gives margins: squash them and normalise.
        raw = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        probs = F.transform(raw, lambda p: p / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))
    added = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn(into, probs).drop(*[c for c in added if c != into])


def importances(model: Model, names: Sequence[str], spark) -> DataFrame:
    """Feature importances of a fitted tree model, one row per feature."""
    values = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def cross_validate(df: DataFrame, fold: str, label: str, k: int, features: str = "features",
                   **training) -> DataFrame:
    """Macro F1 per held-out fold; scaler and model are fitted inside the fold."""
    results = []
    for i in range(k):
        train, held = df.where(F.col(fold) != i), df.where(F.col(fold) == i)
        scaler = Scaler.fit(train, features)
        model = train_trees(scaler.apply(train, features, "scaled"), "scaled", label, **training)
        scored = score_flows(scaler.apply(held, features, "scaled"), model, "scaled").withColumn(
            "predicted", argmax(F.col("probs"))
        )
        summary = report_summary(class_report(scored, label, "predicted"))
        results.append(summary.withColumn("fold", F.lit(i)))
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out.select("fold", "macro_f1", "accuracy", "support")


def score_windows(
    df: DataFrame, score: Callable[[pd.DataFrame], Sequence[Sequence[float]]],
    into: str = "window_probs",
) -> DataFrame:
    """Apply a scorer to Arrow batches of windows: DataFrame -> class probabilities."""
    schema = T.StructType(df.schema.fields + [T.StructField(into, T.ArrayType(T.DoubleType()))])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            given = part.to_pandas()
            for name, kind in given.dtypes.items():
                if isinstance(kind, pd.DatetimeTZDtype):
                    given[name] = given[name].dt.tz_convert(None)
            probs = [[float(p) for p in row] for row in score(given)]
            yield part.append_column(into, pa.array(probs, pa.list_(pa.float64())))

    return df.mapInArrow(batches, schema)


#: What a window's rows are pooled to, per feature.
POOLS = ("mean", "deviation", "last")


def pooled_window(df: DataFrame, window: str = "window", into: str = "pooled",
                  parts: Sequence[str] = ("mean",)) -> DataFrame:
    """Statistics of each feature over the rows of a window, for a vector classifier.

    ``parts`` of ``mean``, population ``deviation`` and ``last`` row, one
    after the other.
    """
    unknown = set(parts) - set(POOLS)
    if unknown:
        raise ValueError(f"unknown parts {sorted(unknown)}")
    schema = T.StructType(df.schema.fields + [T.StructField(into, T.ArrayType(T.DoubleType()))])
    place = df.columns.index(window)

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(into, _pooled(batch.column(place), parts))

    return df.mapInArrow(batches, schema)


def _pooled(windows: pa.Array, parts: Sequence[str]) -> pa.Array:
    """Pools of windows: all at once where they are of one shape without nulls, else one by one."""
    flows = windows.flatten()
    values = flows.flatten()
    n, rows = len(windows), len(flows) // max(len(windows), 1)
    width = len(values) // max(len(flows), 1)
    whole = not (windows.null_count or flows.null_count or values.null_count) and rows and (
        pc.all(pc.equal(pc.list_value_length(windows), rows)).as_py()
        and pc.all(pc.equal(pc.list_value_length(flows), width)).as_py()
    )
    if not whole:
        return pa.array([_pooled_alone(w, parts) for w in windows.to_pylist()], pa.list_(pa.float64()))
    x = values.to_numpy(zero_copy_only=False).reshape(n, rows, width)
    mean = np.zeros((n, width))
    for r in range(rows):
        mean += x[:, r]
    mean /= rows
    spread = np.zeros((n, width))
    if "deviation" in parts:
        for r in range(rows):
            spread += (x[:, r] - mean) ** 2
    pools = {"mean": mean, "deviation": np.sqrt(spread / rows), "last": x[:, -1].astype(float)}
    flat = np.concatenate([pools[p] for p in parts], axis=1)
    ends = np.arange(n + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))


def _pooled_alone(rows: list | None, parts: Sequence[str]) -> list | None:
    """Pools of one window; a value that a row lacks makes its feature's mean and deviation null."""
    if not rows or rows[0] is None or not parts:
        return None if parts else []
    columns = [[None if r is None or i >= len(r) else r[i] for r in rows] for i in range(len(rows[0]))]
    known = [None not in c for c in columns]
    mean = [sum(c) / len(rows) if k else None for c, k in zip(columns, known)]
    pools = {
        "mean": mean, "last": rows[-1],
        "deviation": [(sum((x - m) ** 2 for x in c) / len(rows)) ** 0.5 if k else None
                      for c, k, m in zip(columns, known, mean)],
    }
    out = [pools[p] for p in parts]
    return None if None in out else [x for pool in out for x in pool]


@dataclass
class WindowModel:
    """A classifier of stacked windows with the scaler it was trained with.

    ``classes`` are the labels in the order of the probabilities.
    """

    model: Model
    scaler: Scaler
    classes: list[int]
    parts: tuple[str, ...] = POOLS

    def score(self, df: DataFrame, window: str = "window", into: str = "window_probs") -> DataFrame:
        """Add one probability per class; what ``score_window`` of a detector is."""
        pooled = self.scaler.apply(pooled_window(df, window, "__pooled", self.parts), "__pooled", "__scaled")
        return score_flows(pooled, self.model, "__scaled", into).drop("__pooled", "__scaled")

    def predict(self, df: DataFrame, window: str = "window", into: str = "predicted") -> DataFrame:
        """Add the likeliest label."""
        labels = F.array(*[F.lit(c) for c in self.classes])
        scored = self.score(df, window, "__probs")
        return scored.withColumn(into, F.get(labels, argmax(F.col("__probs")))).drop("__probs")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.scaler.to_df(spark).write.mode("overwrite").parquet(f"{path}/scaler")
        spark.createDataFrame(
            [(type(self.model).__name__, self.classes, list(self.parts))],
            "kind string, classes array<int>, parts array<string>",
        ).write.mode("overwrite").parquet(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "WindowModel":
        params = spark.read.parquet(f"{path}/params").first()
        kinds = {k.__name__: k for k in (LogisticRegressionModel, MultilayerPerceptronClassificationModel)}
        return cls(
            kinds[params["kind"]].load(f"{path}/model"),
            Scaler.from_df(spark.read.parquet(f"{path}/scaler")),
            list(params["classes"]), tuple(params["parts"]),
        )


def train_window_model(
    windows: DataFrame, label: str = "label", window: str = "window",
    parts: Sequence[str] = POOLS, hidden: Sequence[int] = (), weighted: bool = True,
    regularisation: float = 1e-4, iterations: int = 200, seed: int = 42,
) -> WindowModel:
    """Train a window classifier by gradient descent on pooled, scaled windows.

    Multinomial regression, or with ``hidden`` layer sizes a perceptron.
    Classes are the labels that occur, balanced by weights unless told not to
    (the perceptron takes none). Rows without a label are left out. The
    pooled windows are checkpointed: scaler, weights and every iteration read
    them.
    """
    shared_dir(windows.sparkSession)
    known = windows.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias(label), window)
    pooled = pooled_window(known, window, "__pooled", parts).select(label, "__pooled").checkpoint()
    classes = sorted(r[0] for r in pooled.select(label).distinct().collect())  # as many as labels
    if len(classes) < 2:
        raise ValueError("windows of two classes at least are needed")
    scaler = Scaler.fit(pooled, "__pooled")
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    data = scaler.apply(pooled, "__pooled", "__scaled").select(
        place.cast("double").alias("y"), array_to_vector(F.col("__scaled")).alias("vec")
    )
    if hidden:
        layers = [len(scaler.mean), *hidden, len(classes)]
        model = MultilayerPerceptronClassifier(
            featuresCol="vec", labelCol="y", layers=layers, maxIter=iterations, seed=seed
        ).fit(data)
        return WindowModel(model, scaler, classes, tuple(parts))
    regression = LogisticRegression(
        featuresCol="vec", labelCol="y", family="multinomial", regParam=regularisation,
        maxIter=iterations, tol=1e-9, standardization=False,
    )
    if weighted:
        data = attach_weights(data, class_weights(data, "y"), "y", "weight")
        regression.setWeightCol("weight")
    return WindowModel(regression.fit(data), scaler, classes, tuple(parts))
