"""Scaling and distribution alignment between a source and a target domain.

Only ``d`` means, ``d`` deviations and ``d x d`` covariances reach the driver,
with ``d`` the number of features.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


# Fixed values of the alignment.
REGULARISATION = 1e-5
EIGEN_FLOOR = 1e-12
FLAT_STD = 1e-6


def elements(vector: str, width: int) -> list[Column]:
    """The vector column as one double expression per feature."""
    return [F.get(F.col(vector), F.lit(i)).cast("double") for i in range(width)]


def vector_width(df: DataFrame, vector: str) -> int:
    first = df.select(F.size(vector).alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    return first["d"]


def column_stats(df: DataFrame, values: Sequence[Column]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation per column; one aggregation."""
    row = df.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)],
    ).first()
    d = len(values)
    got = np.array([np.nan if x is None else x for x in row], dtype=float)
    return got[:d], got[d:]


@dataclass
class Scaler:
    """Per-feature mean and scale; a constant feature has scale 1."""

    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(
        cls, df: DataFrame, vector: str = "features", flat_below: float | None = None,
    ) -> "Scaler":
        """Fit on all rows; ``flat_below`` treats deviations under it as constant."""
        mean, std = column_stats(df, elements(vector, vector_width(df, vector)))
        flat = std == 0 if flat_below is None else std < flat_below
        return cls(mean, np.where(flat, 1.0, std))

    def apply(self, df: DataFrame, vector: str = "features", into: str = "scaled") -> DataFrame:
        """Standardise with the fitted values as literals (JVM arithmetic)."""
        cols = elements(vector, len(self.mean))
        return df.withColumn(into, F.array(*[
            (c - F.lit(float(m))) / F.lit(float(s))
            for c, m, s in zip(cols, self.mean, self.scale)
        ]))

    def to_df(self, spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
        names = names or [str(i) for i in range(len(self.mean))]
        rows = [
            (i, n, float(m), float(s))
            for i, (n, m, s) in enumerate(zip(names, self.mean, self.scale))
        ]
        return spark.createDataFrame(rows, "pos int, feature string, mean double, scale double")

    @classmethod
    def from_df(cls, df: DataFrame) -> "Scaler":
        rows = df.orderBy("pos").select("mean", "scale").collect()
        return cls(np.array([r["mean"] for r in rows]), np.array([r["scale"] for r in rows]))


#: Groups that the moments of all tasks are merged in before the driver merges theirs.
BUNDLES = 64


@dataclass
class Moments:
    """Count, mean, centred Gram matrix and extremes of vectors; two of them merge into one.

    A column whose extremes agree is constant: its sums are exactly zero
    whatever the rounding of its mean.
    """

    n: float
    mean: np.ndarray
    gram: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "Moments":
        low, high = x.min(axis=0), x.max(axis=0)
        flat = low == high
        mean = np.where(flat, low, x.mean(axis=0))
        centred = x - mean
        return cls(float(len(x)), mean, centred.T @ centred, low, high)

    def merged(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        low, high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)
        step = other.mean - self.mean
        mean = np.where(low == high, low, self.mean + step * (other.n / n))
        gram = self.gram + other.gram + np.outer(step, step) * (self.n * other.n / n)
        return Moments(n, mean, gram, low, high)

    @property
    def deviation(self) -> np.ndarray:
        """Population deviation per column."""
        return np.sqrt(np.diag(self.gram) / self.n)

    def covariance(self) -> np.ndarray:
        """Sample covariance."""
        return self.gram / (self.n - 1)

    def scaler(self) -> Scaler:
        std = self.deviation
        return Scaler(self.mean, np.where(std == 0, 1.0, std))

    def row(self) -> pd.DataFrame:
        parts = {c: [getattr(self, c).ravel()] for c in ("mean", "gram", "low", "high")}
        return pd.DataFrame({"n": [self.n], **parts})

    @classmethod
    def from_row(cls, row) -> "Moments":
        mean, gram, low, high = (np.asarray(row[c], dtype=float) for c in ("mean", "gram", "low", "high"))
        return cls(row["n"], mean, gram.reshape(len(mean), len(mean)), low, high)


_MOMENTS = "n double, mean array<double>, gram array<double>, low array<double>, high array<double>"


def moments(df: DataFrame, vector: str = "features") -> Moments:
    """Moments of a vector column in one scan.

    Each task reduces its rows to one matrix; bundles of tasks merge theirs,
    and the driver merges ``BUNDLES`` of d x d numbers, whatever the number of
    tasks. Rows are told to be of one width; another raises an error.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = None
        for batch in batches:
            if len(batch):
                part = Moments.of(np.stack(batch[vector].to_numpy()).astype(float))
                whole = part if whole is None else whole.merged(part)
        if whole is not None:
            yield whole.row()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return reduce(Moments.merged, (Moments.from_row(r) for _, r in rows.iterrows())).row()

    parts = df.select(vector).mapInPandas(partial, _MOMENTS)
    bundle = F.pmod(F.spark_partition_id(), F.lit(BUNDLES))
    merged = parts.groupBy(bundle.alias("bundle")).applyInPandas(merge, _MOMENTS).collect()
    if not merged:
        raise ValueError("no rows to fit on")
    return reduce(Moments.merged, map(Moments.from_row, merged))


def covariance(df: DataFrame, vector: str = "features", regularisation: float = 0.0) -> np.ndarray:
    """Sample covariance (n - 1) plus a multiple of the identity; one scan."""
    out = moments(df, vector).covariance()
    return out + regularisation * np.eye(len(out))


def covariance_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    d = len(matrix)
    rows = [(i, j, float(matrix[i, j])) for i in range(d) for j in range(d)]
    return spark.createDataFrame(rows, "i int, j int, cov double")


def _power(matrix: np.ndarray, exponent: float) -> np.ndarray:
    """Symmetric matrix power with an eigenvalue floor."""
    values, vectors = np.linalg.eigh(matrix)
    return (vectors * np.maximum(values, EIGEN_FLOOR) ** exponent) @ vectors.T


def _linear(df: DataFrame, vector: str, into: str, shift_in, matrix, shift_out) -> DataFrame:
    """``(x - shift_in) @ matrix + shift_out`` on Arrow batches."""
    a, m, b = np.asarray(shift_in), np.asarray(matrix), np.asarray(shift_out)
    width = len(a)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def transform(column: pd.Series) -> pd.Series:
        x = np.stack(column.to_numpy()).astype(float)
        if x.shape[1] != width:
            raise ValueError(f"expected {width} features, got {x.shape[1]}")
        return pd.Series(list((x - a) @ m + b))

    return df.withColumn(into, transform(F.col(vector)))


@dataclass
class CoralAdapter:
    """Second-order alignment: whiten the source, colour it like the target.

    ``identity_target`` leaves target rows only scaled. Results are in scaled
    units; ``raw_units`` scales them back so that a model with its own scaler
    does not standardise twice.
    """

    scaler: Scaler
    source_mean: np.ndarray
    target_mean: np.ndarray
    source_cov: np.ndarray
    target_cov: np.ndarray
    regularisation: float = REGULARISATION
    identity_target: bool = False

    @classmethod
    def fit(
        cls, source: DataFrame, target: DataFrame, vector: str = "features",
        regularisation: float = REGULARISATION, scale_on: str | None = "source",
        identity_target: bool = False,
    ) -> "CoralAdapter":
        """Fit means, scale and covariances in one scan of each side; ``scale_on``: source, union or None."""
        sides = [moments(side, vector) for side in (source, target)]
        d = len(sides[0].mean)
        if len(sides[1].mean) != d:
            raise ValueError("source and target differ in their number of features")
        if scale_on == "source":
            scaler = sides[0].scaler()
        elif scale_on == "union":
            scaler = sides[0].merged(sides[1]).scaler()
        elif scale_on is None:
            scaler = Scaler(np.zeros(d), np.ones(d))
        else:
            raise ValueError("scale_on must be 'source', 'union' or None")
        stats = []
        for side in sides:
            # Scaling is linear: the covariance follows from the raw one.
            cov = side.covariance() / np.outer(scaler.scale, scaler.scale)
            stats.append(((side.mean - scaler.mean) / scaler.scale,
                          cov + regularisation * np.eye(d)))
        (sm, sc), (tm, tc) = stats
        adapter = cls(scaler, sm, tm, sc, tc, regularisation, identity_target)
        adapter.check()
        return adapter

    @property
    def matrix(self) -> np.ndarray:
        return _power(self.source_cov, -0.5) @ _power(self.target_cov, 0.5)

    def check(self) -> None:
        """Fail before any data is touched when the adapter cannot be applied."""
        d = len(self.source_mean)
        if self.source_cov.shape != (d, d) or self.target_cov.shape != (d, d):
            raise ValueError("adapter matrices do not fit its feature width")
        for part in (self.matrix, self.source_mean, self.target_mean, self.scaler.scale):
            if not np.all(np.isfinite(part)):
                raise ValueError("adapter holds values that are not finite")

    def transform_source(self, df: DataFrame, vector: str = "features", into: str = "aligned",
                         raw_units: bool = False) -> DataFrame:
        """Source rows moved to the target's distribution (training side)."""
        return self._move(df, vector, into, self.source_mean, self.matrix, self.target_mean, raw_units)

    def transform_target(self, df: DataFrame, vector: str = "features", into: str = "aligned",
                         raw_units: bool = False) -> DataFrame:
        """Target rows moved to the source's distribution (serving side)."""
        if self.identity_target:
            zero = np.zeros(len(self.source_mean))
            return self._move(df, vector, into, zero, np.eye(len(zero)), zero, raw_units)
        return self._move(
            df, vector, into, self.target_mean, np.linalg.inv(self.matrix), self.source_mean, raw_units
        )

    def _move(self, df, vector, into, from_mean, matrix, to_mean, raw_units) -> DataFrame:
        # Fold the scaling into the linear map: one pass over the vector.
        m, s = self.scaler.mean, self.scaler.scale
        a = m + from_mean * s
        full = matrix / s[:, None]
        if raw_units:
            return _linear(df, vector, into, a, full * s[None, :], to_mean * s + m)
        return _linear(df, vector, into, a, full, to_mean)

    def quality(self, spark: SparkSession) -> DataFrame:
        """Distance of the covariances, trace ratio and condition numbers."""
        cs, ct = self.source_cov, self.target_cov
        row = (
            float(np.linalg.norm(cs - ct, "fro")), float(np.trace(ct) / np.trace(cs)),
            float(np.linalg.cond(cs)), float(np.linalg.cond(ct)),
            len(self.source_mean), float(self.regularisation),
        )
        return spark.createDataFrame([row], (
            "frobenius_distance double, trace_ratio_target_over_source double, "
            "condition_number_source double, condition_number_target double, "
            "n_features int, lambda_reg double"
        ))

    def save(self, spark: SparkSession, path: str) -> None:
        row = (
            [float(x) for x in self.scaler.mean], [float(x) for x in self.scaler.scale],
            [float(x) for x in self.source_mean], [float(x) for x in self.target_mean],
            self.source_cov.ravel().tolist(), self.target_cov.ravel().tolist(),
            json.dumps({"regularisation": self.regularisation,
                        "identity_target": self.identity_target}),
        )
        spark.createDataFrame([row], (
            "mean array<double>, scale array<double>, source_mean array<double>, "
            "target_mean array<double>, source_cov array<double>, target_cov array<double>, "
            "options string"
        )).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CoralAdapter":
        row = spark.read.parquet(path).first()
        d = len(row["mean"])
        adapter = cls(
            Scaler(np.array(row["mean"]), np.array(row["scale"])),
            np.array(row["source_mean"]), np.array(row["target_mean"]),
            np.array(row["source_cov"]).reshape(d, d), np.array(row["target_cov"]).reshape(d, d),
            **json.loads(row["options"]),
        )
        adapter.check()
        return adapter


def coral_loss(
    source: DataFrame, target: DataFrame, vector: str = "features",
    regularisation: float = 0.0, normalised: bool = False, weight: float = 1.0,
) -> float:
    """Squared Frobenius distance of the covariances, optionally over ``4 d^2``."""
    cs = covariance(source, vector, regularisation=regularisation)
    ct = covariance(target, vector, regularisation=regularisation)
    loss = float(np.sum((cs - ct) ** 2))
    return weight * loss / (4 * len(cs) ** 2) if normalised else weight * loss


@dataclass
class FeaturewiseAdapter:
    """Per-feature mean and deviation shift, without rotation."""

    source: Scaler
    target: Scaler
    mode: str = "standardize"

    @classmethod
    def fit(cls, source: DataFrame, target: DataFrame, vector: str = "features",
            mode: str = "standardize") -> "FeaturewiseAdapter":
        if mode not in ("rescale", "mean_only", "standardize"):
            raise ValueError("mode must be rescale, mean_only or standardize")
        return cls(
            Scaler.fit(source, vector, flat_below=FLAT_STD),
            Scaler.fit(target, vector, flat_below=FLAT_STD), mode,
        )

    def transform_target(self, df: DataFrame, vector: str = "features",
                         into: str = "aligned") -> DataFrame:
        moved = []
        for i, x in enumerate(elements(vector, len(self.target.mean))):
            tm, ts = float(self.target.mean[i]), float(self.target.scale[i])
            sm, ss = float(self.source.mean[i]), float(self.source.scale[i])
            if self.mode == "rescale":
                moved.append((x - tm) / ts * ss + sm)
            elif self.mode == "mean_only":
                moved.append(x - tm + sm)
            else:
                moved.append((x - tm) / ts)
        return df.withColumn(into, F.array(*moved))
