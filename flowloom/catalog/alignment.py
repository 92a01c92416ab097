"""Scaling, covariance, alignment and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.align import (
    CoralAdapter, FeaturewiseAdapter, Scaler, coral_loss, covariance, covariance_table,
)
from ..operators.sampling import group_folds, stratified_split, top_k
from ..operators.scoring import argmax, cross_validate, importances, score_flows, train_trees
from ..operators.metrics import class_report
from .registry import query, rounded, table

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def line_vectors(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn(
        "features", F.array(*[F.col(c).cast("double") for c in MEASURES])
    )


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "features")


def domains(spark, sf_dir):
    """Even ids as the source domain, odd ids as the target domain."""
    df = vectors(spark, sf_dir)
    even = F.pmod(F.col("vec_id"), F.lit(2)) == 0
    return df.where(even), df.where(~even)


@query("scale_fit", " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS scale FROM lineitem"
    for i, c in enumerate(MEASURES)))
def scale_fit(spark, sf_dir):
    return rounded(Scaler.fit(line_vectors(spark, sf_dir)).to_df(spark, MEASURES))


@query("scale_apply", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 5) AS {c}_z"
    for c in MEASURES) + " FROM lineitem")
def scale_apply(spark, sf_dir):
    df = line_vectors(spark, sf_dir)
    out = Scaler.fit(df).apply(df)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[
        F.round(F.get("scaled", F.lit(i)), 5).alias(f"{c}_z") for i, c in enumerate(MEASURES)
    ])


LONG_SQL = """long AS (SELECT vec_id, vec_id % 2 AS side, i, CAST(embedding[i + 1] AS DOUBLE) AS x
  FROM embeddings, range(64) AS r(i))"""
SCALED_SQL = LONG_SQL + """,
src AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM long WHERE side = 0 GROUP BY i),
scaled AS (SELECT l.vec_id, l.side, l.i, (l.x - src.m) / (CASE WHEN src.s = 0 THEN 1 ELSE src.s END) AS z FROM long l JOIN src ON src.i = l.i),
cov AS (SELECT a.side, a.i, b.i AS j, covar_samp(a.z, b.z) + (CASE WHEN a.i = b.i THEN 1e-5 ELSE 0 END) AS c
  FROM scaled a JOIN scaled b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3)"""


@query("covariance", f"""WITH {LONG_SQL} SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.x, b.x), 6) AS cov
FROM long a JOIN long b ON a.vec_id = b.vec_id GROUP BY 1, 2""")
def covariance_query(spark, sf_dir):
    return rounded(covariance_table(spark, covariance(vectors(spark, sf_dir))))


@query("alignment_quality", f"""WITH {SCALED_SQL} SELECT
  round(sqrt(sum((s.c - t.c) * (s.c - t.c))), 5) AS frobenius_distance,
  round(sum(t.c) FILTER (s.i = s.j) / sum(s.c) FILTER (s.i = s.j), 6) AS trace_ratio_target_over_source,
  64 AS n_features FROM cov s JOIN cov t ON t.i = s.i AND t.j = s.j AND t.side = 1 WHERE s.side = 0""")
def alignment_quality(spark, sf_dir):
    q = CoralAdapter.fit(*domains(spark, sf_dir)).quality(spark)
    return q.select(
        F.round("frobenius_distance", 5).alias("frobenius_distance"),
        F.round("trace_ratio_target_over_source", 6).alias("trace_ratio_target_over_source"),
        "n_features",
    )


@query("coral_aligned_means", f"""WITH {SCALED_SQL} SELECT 'source' AS side, CAST(i AS INTEGER) AS pos, round(avg(z), 4) + 0.0 AS mean
  FROM scaled WHERE side = 1 GROUP BY i
UNION ALL SELECT 'target', CAST(i AS INTEGER), 0.0 FROM scaled WHERE side = 0 GROUP BY i""")
def coral_aligned_means(spark, sf_dir):
    """Aligned source rows have the target's means, and the other way round."""
    source, target = domains(spark, sf_dir)
    adapter = CoralAdapter.fit(source, target)
    moved = adapter.transform_source(source).select(F.lit("source").alias("side"), "aligned").unionByName(
        adapter.transform_target(target).select(F.lit("target").alias("side"), "aligned")
    )
    cells = moved.select("side", F.posexplode("aligned").alias("pos", "x"))
    # Adding zero turns a rounded negative zero into zero.
    return cells.groupBy("side", "pos").agg((F.round(F.avg("x"), 4) + F.lit(0.0)).alias("mean"))


@query("coral_aligned_covariance", f"""WITH {SCALED_SQL} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
  round(c - (CASE WHEN i = j THEN 1e-5 ELSE 0 END), 4) + 0.0 AS cov FROM cov WHERE side = 1""")
def coral_aligned_covariance(spark, sf_dir):
    """Without regularisation, aligned source rows have the target's covariance."""
    source, target = domains(spark, sf_dir)
    adapter = CoralAdapter.fit(source, target, regularisation=0.0)
    table_ = covariance_table(spark, covariance(adapter.transform_source(source), "aligned"))
    return table_.select("i", "j", (F.round("cov", 4) + F.lit(0.0)).alias("cov"))


@query("coral_transform")
def coral_transform(spark, sf_dir):
    source, target = domains(spark, sf_dir)
    return CoralAdapter.fit(source, target).transform_target(target, raw_units=True).select(
        "vec_id", "aligned"
    )


@query("coral_loss", f"""WITH {LONG_SQL}, c AS (SELECT a.side, a.i, b.i AS j, covar_samp(a.x, b.x) AS c
  FROM long a JOIN long b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3)
SELECT round(sum((s.c - t.c) * (s.c - t.c)), 6) AS loss, round(sum((s.c - t.c) * (s.c - t.c)) / (4 * 64 * 64), 8) AS normalised
FROM c s JOIN c t ON t.i = s.i AND t.j = s.j AND t.side = 1 WHERE s.side = 0""")
def coral_loss_query(spark, sf_dir):
    source, target = domains(spark, sf_dir)
    loss = coral_loss(source, target)
    return spark.createDataFrame([(round(loss, 6), round(loss / (4 * 64 * 64), 8))],
                                 "loss double, normalised double")


def _cells(df, digits=5):
    return df.select("vec_id", F.posexplode("aligned").alias("pos", "x")).select(
        "vec_id", "pos", (F.round("x", digits) + F.lit(0.0)).alias("x")
    )


@query("union_scaled_target", f"""WITH {LONG_SQL}, st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY i)
SELECT vec_id, CAST(l.i AS INTEGER) AS pos, round((x - m) / (CASE WHEN s = 0 THEN 1 ELSE s END), 5) + 0.0 AS x
FROM long l JOIN st ON st.i = l.i WHERE side = 1""")
def union_scaled_target(spark, sf_dir):
    """Variant scaled on both domains that leaves target rows unrotated."""
    source, target = domains(spark, sf_dir)
    adapter = CoralAdapter.fit(source, target, scale_on="union", identity_target=True)
    return _cells(adapter.transform_target(target))


def _featurewise_sql(expr: str) -> str:
    return f"""WITH {LONG_SQL}, st AS (SELECT side, i, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS s FROM long GROUP BY side, i)
SELECT vec_id, CAST(l.i AS INTEGER) AS pos, round({expr}, 5) + 0.0 AS x FROM long l
JOIN st t ON t.i = l.i AND t.side = 1 JOIN st s ON s.i = l.i AND s.side = 0 WHERE l.side = 1"""


FEATUREWISE = {
    "rescale": "(x - t.m) / t.s * s.s + s.m",
    "mean_only": "x - t.m + s.m",
    "standardize": "(x - t.m) / t.s",
}


def _featurewise(mode):
    def run(spark, sf_dir):
        source, target = domains(spark, sf_dir)
        return _cells(FeaturewiseAdapter.fit(source, target, mode=mode).transform_target(target))

    return run


for _mode, _expr in FEATUREWISE.items():
    query(f"featurewise_{_mode}", _featurewise_sql(_expr))(_featurewise(_mode))


def _split(spark, sf_dir):
    return stratified_split(vectors(spark, sf_dir), "label", {"train": 0.8, "val": 0.2}, ["vec_id"])


@query("train_and_score")
def train_and_score(spark, sf_dir):
    """Scale, weight, train, then report on the held-out part."""
    parts = _split(spark, sf_dir)
    train, held = parts.where(F.col("part") == "train"), parts.where(F.col("part") == "val")
    scaler = Scaler.fit(train)
    model = train_trees(scaler.apply(train), "scaled", trees=20, depth=5)
    scored = score_flows(scaler.apply(held), model, "scaled").withColumn("predicted", argmax(F.col("probs")))
    return class_report(scored, "label", "predicted")


@query("top_importances")
def top_importances(spark, sf_dir):
    model = train_trees(vectors(spark, sf_dir), trees=10, depth=4, weighted=False)
    return top_k(importances(model, [f"v{i}" for i in range(64)], spark), "importance", 15, ["feature"])


@query("cross_validated_f1")
def cross_validated_f1(spark, sf_dir):
    grouped = vectors(spark, sf_dir).withColumn("grp", F.pmod(F.col("vec_id"), F.lit(60)))
    folds = group_folds(grouped, "grp", "label", k=3)
    return cross_validate(folds, "fold", "label", 3, trees=8, depth=4)
