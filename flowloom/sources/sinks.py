"""Writers: alerts, labelled partitions, manifests, curves and parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import bounded
from ..schema import DEFAULT_THRESHOLD

UNMATCHED = "unmatched"


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts of a batch run as JSON lines; replaces an earlier run."""
    alerts.write.mode("overwrite").json(path)


def append_alerts(alerts: DataFrame, path: str, checkpoint: str, live: bool = False,
                  poll: str = "500 milliseconds") -> StreamingQuery:
    """Alerts of a stream as JSON lines, exactly once."""
    writer = (
        alerts.writeStream.format("json").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    return (writer.trigger(processingTime=poll) if live else writer.trigger(availableNow=True)).start()


def write_by_label(df: DataFrame, path: str, label: str = "true_label") -> None:
    """One folder per label; rows without a label go to ``unmatched``.

    Rebalancing gathers a label's rows into few files and still splits a label
    that is too large for one task.
    """
    parts = df.withColumn("part", F.coalesce(F.col(label), F.lit(UNMATCHED)))
    parts.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").json(path)


def write_scenarios(df: DataFrame, path: str, scenario: str = "scenario") -> None:
    """One folder per scenario; reading the root gives the combined table.

    Only the scenarios in ``df`` are replaced, so a repeated run is harmless.
    """
    df.hint("rebalance", scenario).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(scenario).parquet(path)


def pending(df: DataFrame, manifest: str, scenario: str = "scenario") -> DataFrame:
    """Rows of scenarios that the manifest does not list as completed."""
    done = _manifest(df.sparkSession, manifest, scenario)
    return df if done is None else df.join(bounded(done), scenario, "left_anti")


def complete(
    df: DataFrame, manifest: str, write: Callable[[DataFrame], None], scenario: str = "scenario"
) -> None:
    """Write the pending scenarios, then list them.

    The write replaces whole scenarios, so a run that dies between the two
    steps is repeated without duplicates.
    """
    todo = pending(df, manifest, scenario)
    names = todo.select(scenario).distinct().checkpoint()
    write(todo)
    names.write.mode("append").parquet(manifest)


def _manifest(spark: SparkSession, path: str, scenario: str) -> DataFrame | None:
    """Completed scenario names: one row per capture folder."""
    try:
        return spark.read.parquet(path).select(scenario).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # nothing has been completed yet


def write_windows(windows: DataFrame, path: str) -> None:
    """Window dataset: group, label and the size x width matrix."""
    windows.write.mode("overwrite").parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Curve or metrics rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_bundle(spark: SparkSession, path: str, model, scaler, classes: dict[int, str],
                threshold: float | None, version: str, metrics: dict[str, float] | None = None) -> None:
    """Model and the parameters it is served with."""
    model.write().overwrite().save(f"{path}/model")
    scaler.to_df(spark).write.mode("overwrite").parquet(f"{path}/scaler")
    spark.createDataFrame(
        [(threshold, version, {int(k): v for k, v in classes.items()},
          {k: float(v) for k, v in (metrics or {}).items()})],
        "threshold double, version string, classes map<int,string>, metrics map<string,double>",
    ).write.mode("overwrite").parquet(f"{path}/params")


def load_bundle(spark: SparkSession, path: str, model_type) -> dict:
    """Model, scaler, class map, threshold (default when absent), version, metrics."""
    from ..operators.align import Scaler

    params = spark.read.parquet(f"{path}/params").first()
    return {
        "model": model_type.load(f"{path}/model"),
        "scaler": Scaler.from_df(spark.read.parquet(f"{path}/scaler")),
        "classes": dict(params["classes"]),
        "threshold": DEFAULT_THRESHOLD if params["threshold"] is None else params["threshold"],
        "version": params["version"],
        "metrics": dict(params["metrics"]),
    }
