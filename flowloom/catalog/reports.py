"""Counts, classification reports and threshold curves on scored lineitem rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timefmt import micros
from ..operators.features import duration_s
from ..operators.metrics import (
    adaptation_effect, binary_metrics, class_distribution, class_report, class_weights,
    confusion_matrix, dominant_label, end_to_end_recall, first_threshold_within, grid,
    latency_summary, leakage_audit, linear_grid, model_matrix, operating_curve, pr_auc, pr_curve,
    recall_at, report_summary, source_concentration, threshold_for_far, threshold_for_recall,
)
from .registry import EVE_SQL, LINES_SQL, flows, query, rounded, scored_lines, table



def attack():
    return F.col("label") != "N"



@query("class_distribution", f"""WITH {LINES_SQL} SELECT label, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM lines GROUP BY label""")
def class_distribution_query(spark, sf_dir):
    return rounded(class_distribution(scored_lines(spark, sf_dir)), 4)


@query("class_weights", f"""WITH {LINES_SQL}, c AS (SELECT label, count(*) AS n FROM lines GROUP BY label)
SELECT label, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight FROM c
UNION ALL SELECT 'Z', 0, 1.0""")
def class_weights_query(spark, sf_dir):
    return rounded(class_weights(scored_lines(spark, sf_dir), classes=["A", "N", "R", "Z"]))


@query("binary_metrics", f"""WITH {LINES_SQL}, c AS (SELECT
  count(*) FILTER (label <> 'N' AND score >= 0.84) AS tp, count(*) FILTER (label = 'N' AND score >= 0.84) AS fp,
  count(*) FILTER (label <> 'N' AND score < 0.84) AS fn, count(*) FILTER (label = 'N' AND score < 0.84) AS tn FROM lines)
SELECT *, round(fp / (fp + tn + 1e-10), 6) AS far, round(tp / (tp + fn + 1e-10), 6) AS recall FROM c""")
def binary_metrics_query(spark, sf_dir):
    return rounded(binary_metrics(scored_lines(spark, sf_dir), attack(), F.col("score") >= 0.84))


@query("document_metrics", """WITH d AS (SELECT l.quality, CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS toxic,
  least(doc.n_chars / 5000.0, 1.0) AS score FROM labels l JOIN documents doc ON doc.doc_id = l.doc_id),
c AS (SELECT count(*) FILTER (toxic = 1 AND score >= 0.5) AS tp, count(*) FILTER (toxic = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (toxic = 1 AND score < 0.5) AS fn, count(*) FILTER (toxic = 0 AND score < 0.5) AS tn FROM d)
SELECT *, round(fp / (fp + tn + 1e-10), 6) AS far, round(tp / (tp + fn + 1e-10), 6) AS recall FROM c""")
def document_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn(
        "score", F.least(F.col("n_chars") / 5000.0, F.lit(1.0))
    )
    return rounded(binary_metrics(joined, F.col("toxic") == 1, F.col("score") >= 0.5))


@query("recall_at", f"""WITH {LINES_SQL}, c AS (SELECT label, count(*) AS n,
  count(*) FILTER (score >= 0.84) AS detected FROM lines WHERE label <> 'N' GROUP BY label)
SELECT label, n, detected, round(detected / n, 6) AS recall, round(avg(detected / n) OVER (), 6) AS macro_recall,
  round(CAST(sum(detected) OVER () / sum(n) OVER () AS DOUBLE), 6) AS pooled_recall FROM c""")
def recall_at_query(spark, sf_dir):
    return rounded(recall_at(scored_lines(spark, sf_dir), "label", "score", 0.84, "N"))


REPORT_SQL = f"""{LINES_SQL}, classes AS (SELECT DISTINCT label AS c FROM lines UNION SELECT DISTINCT predicted FROM lines),
r AS (SELECT c AS class, (SELECT count(*) FROM lines WHERE label = c) AS support,
  (SELECT count(*) FROM lines WHERE predicted = c) AS claimed,
  (SELECT count(*) FROM lines WHERE predicted = c AND label = c) AS tp FROM classes),
rep AS (SELECT *, tp / claimed AS precision, tp / support AS recall,
  2 * (tp / claimed) * (tp / support) / ((tp / claimed) + (tp / support)) AS f1 FROM r)"""


@query("class_report", f"""WITH {REPORT_SQL} SELECT class, support, tp, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rep""")
def class_report_query(spark, sf_dir):
    return rounded(class_report(scored_lines(spark, sf_dir), "label", "predicted"))


@query("report_summary", f"""WITH {REPORT_SQL} SELECT round(CAST(sum(tp) / sum(support) AS DOUBLE), 6) AS accuracy,
  round(avg(f1), 6) AS macro_f1, round(CAST(sum(f1 * support) / sum(support) AS DOUBLE), 6) AS weighted_f1,
  CAST(sum(support) AS BIGINT) AS support FROM rep""")
def report_summary_query(spark, sf_dir):
    return rounded(report_summary(class_report(scored_lines(spark, sf_dir), "label", "predicted")))


@query("confusion_matrix", f"""WITH {LINES_SQL} SELECT label, count(*) FILTER (predicted = 'A') AS "A",
  count(*) FILTER (predicted = 'N') AS "N", count(*) FILTER (predicted = 'R') AS "R" FROM lines GROUP BY label""")
def confusion_query(spark, sf_dir):
    return confusion_matrix(scored_lines(spark, sf_dir), "label", "predicted", ["A", "N", "R"])


CURVE_SQL = f"""{LINES_SQL}, pts AS (SELECT score AS threshold, count(*) FILTER (label <> 'N') AS pos,
  count(*) FILTER (label = 'N') AS neg FROM lines GROUP BY score),
cum AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  CAST(sum(pos) OVER () AS BIGINT) AS p FROM pts WINDOW w AS (ORDER BY threshold DESC)),
curve AS (SELECT threshold, tp, fp, tp / (tp + fp) AS precision, tp / p AS recall FROM cum),
areas AS (SELECT *, (recall - lag(recall, 1, 0) OVER o) * (precision + lag(precision, 1, 1) OVER o) / 2 AS area
  FROM curve WINDOW o AS (ORDER BY threshold DESC))"""


@query("pr_curve", f"""WITH {CURVE_SQL} SELECT round(threshold, 6) AS threshold, tp, fp, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(area, 7) AS area FROM areas""")
def pr_curve_query(spark, sf_dir):
    out = pr_curve(scored_lines(spark, sf_dir), attack(), "score")
    return rounded(out.drop("area")).join(
        out.select(F.round("threshold", 6).alias("threshold"), F.round("area", 7).alias("area")), "threshold"
    )


@query("pr_auc", f"WITH {CURVE_SQL} SELECT round(sum(area), 6) AS pr_auc FROM areas")
def pr_auc_query(spark, sf_dir):
    return rounded(pr_auc(pr_curve(scored_lines(spark, sf_dir), attack(), "score")))


def _grid_sql(count: int, expr: str) -> str:
    return f"""{LINES_SQL}, grid AS (SELECT {expr} AS t FROM range({count}) AS r(i)),
hist AS (SELECT label, score, count(*) AS n FROM lines GROUP BY label, score),
oc AS (SELECT t AS threshold,
  CAST(coalesce(sum(n) FILTER (label = 'N' AND score >= t), 0) AS BIGINT) AS false_alarms,
  CAST(coalesce(sum(n) FILTER (label = 'N' AND score >= t), 0) / sum(n) FILTER (label = 'N') AS DOUBLE) AS far,
  CAST(coalesce(sum(n) FILTER (label = 'A' AND score >= t), 0) / sum(n) FILTER (label = 'A') AS DOUBLE) AS ra,
  CAST(coalesce(sum(n) FILTER (label = 'R' AND score >= t), 0) / sum(n) FILTER (label = 'R') AS DOUBLE) AS rr,
  CAST(coalesce(sum(n) FILTER (label <> 'N' AND score >= t), 0) / sum(n) FILTER (label <> 'N') AS DOUBLE) AS pooled
  FROM grid, hist GROUP BY t)"""


HUNDREDTHS = _grid_sql(50, "(50 + i) / 100.0::DOUBLE")


def _curve(spark, sf_dir, thresholds):
    return operating_curve(scored_lines(spark, sf_dir), "label", "score", thresholds, "N", ["A", "R"])


@query("operating_curve", f"""WITH {HUNDREDTHS} SELECT round(threshold, 2) AS threshold, false_alarms, round(far, 6) AS far,
  round(ra, 6) AS "recall_A", round(rr, 6) AS "recall_R", round(pooled, 6) AS pooled_recall,
  round((ra + rr) / 2, 6) AS macro_recall FROM oc""")
def operating_curve_query(spark, sf_dir):
    return rounded(_curve(spark, sf_dir, grid(50, 99)))


@query("threshold_for_recall", f"""WITH {CURVE_SQL} SELECT coalesce((SELECT threshold FROM curve WHERE recall >= 0.95
  ORDER BY precision DESC, threshold LIMIT 1), 0.5) AS threshold""")
def threshold_for_recall_query(spark, sf_dir):
    return threshold_for_recall(pr_curve(scored_lines(spark, sf_dir), attack(), "score"))


@query("threshold_for_far", f"""WITH {HUNDREDTHS}, best AS (SELECT threshold, pooled FROM oc WHERE far < 0.1 AND pooled > 0
  ORDER BY pooled DESC, threshold LIMIT 1)
SELECT round(coalesce((SELECT threshold FROM best), 0.5), 2) AS threshold,
  round(coalesce((SELECT pooled FROM best), 0.0), 4) AS recall""")
def threshold_for_far_query(spark, sf_dir):
    best = threshold_for_far(_curve(spark, sf_dir, grid(50, 99)), 0.1)
    return best.select(F.round("threshold", 2).alias("threshold"), F.round("recall", 4).alias("recall"))


@query("first_threshold_within", f"""WITH {_grid_sql(100, "0.60::DOUBLE + ((0.95::DOUBLE - 0.60::DOUBLE) / 99) * i")}
SELECT round(coalesce((SELECT min(threshold) FROM oc WHERE far * 100 <= 10), 0.84), 6) AS threshold""")
def first_threshold_query(spark, sf_dir):
    return rounded(first_threshold_within(_curve(spark, sf_dir, linear_grid(0.60, 0.95, 100)), 10.0, 0.84))


@query("model_matrix", f"""WITH {LINES_SQL}, s AS (SELECT 'base' AS model, label, score AS score, 0.84 AS t FROM lines
  UNION ALL SELECT 'candidate', label, 1 - score, 0.70 FROM lines)
SELECT model, round(avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END) FILTER (label = 'A'), 6) AS "recall_A",
  round(avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END) FILTER (label = 'R'), 6) AS "recall_R",
  round(avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END) FILTER (label <> 'N'), 6) AS recall_all,
  round(avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END) FILTER (label = 'N'), 6) AS far FROM s GROUP BY model""")
def model_matrix_query(spark, sf_dir):
    base = scored_lines(spark, sf_dir).select("label", "score")
    both = base.select(F.lit("base").alias("model"), "label", "score", F.lit(0.84).alias("threshold")).unionByName(
        base.select(F.lit("candidate").alias("model"), "label", (1 - F.col("score")).alias("score"),
                    F.lit(0.70).alias("threshold"))
    )
    return rounded(model_matrix(both, ["A", "R"], "N"))


@query("adaptation_effect", f"""WITH {LINES_SQL}, c AS (SELECT count(*) AS n_target,
  count(*) FILTER (score >= 0.66) AS fp_count_before, count(*) FILTER (score * 0.8 >= 0.66) AS fp_count_after
  FROM lines WHERE label = 'N')
SELECT *, round(fp_count_before / n_target, 6) AS fp_before, round(fp_count_after / n_target, 6) AS fp_after,
  round((fp_count_before / n_target - fp_count_after / n_target) * 100 / (fp_count_before / n_target), 4) AS improvement_pct FROM c""")
def adaptation_effect_query(spark, sf_dir):
    benign = scored_lines(spark, sf_dir).where(~attack()).withColumn("after", F.col("score") * 0.8)
    out = adaptation_effect(benign, "score", "after", 0.66)
    return rounded(out).withColumn("improvement_pct", F.round("improvement_pct", 4))


@query("end_to_end_recall", f"""WITH {LINES_SQL} SELECT label, count(*) AS total, count(*) FILTER (score >= 0.84) AS alerts,
  round(count(*) FILTER (score >= 0.84) * 100.0 / count(*), 4) AS recall_pct FROM lines WHERE label <> 'N' GROUP BY label""")
def end_to_end_query(spark, sf_dir):
    attacks = scored_lines(spark, sf_dir).where(attack())
    return rounded(end_to_end_recall(attacks, attacks.where(F.col("score") >= 0.84)), 4)


@query("dominant_label", f"""WITH {LINES_SQL}, c AS (SELECT l_suppkey, label, count(*) AS n FROM lines GROUP BY 1, 2)
SELECT l_suppkey, label AS dominant FROM c
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, label) = 1""")
def dominant_query(spark, sf_dir):
    return dominant_label(scored_lines(spark, sf_dir), ["l_suppkey"], "label")


@query("source_concentration", f"""WITH {LINES_SQL}, c AS (SELECT label, l_suppkey, count(*) AS n FROM lines GROUP BY 1, 2)
SELECT label, CAST(sum(n) AS BIGINT) AS n, count(*) AS sources, max(n) AS top_n,
  arg_max(l_suppkey, n * 1000000 + l_suppkey) AS top_source, round(CAST(max(n) / sum(n) AS DOUBLE), 6) AS top_share
FROM c GROUP BY label""")
def concentration_query(spark, sf_dir):
    return rounded(source_concentration(scored_lines(spark, sf_dir), source="l_suppkey"))


@query("leakage_audit", f"""WITH {LINES_SQL}, tr AS (SELECT * FROM lines WHERE score < 0.8), ho AS (SELECT * FROM lines WHERE score >= 0.8)
SELECT count(*) AS holdout_rows,
  count(*) FILTER ((l_quantity, l_discount, l_tax) IN (SELECT (l_quantity, l_discount, l_tax) FROM tr)) AS same_signature,
  count(*) FILTER (l_partkey IN (SELECT l_partkey FROM tr)) AS same_source FROM ho""")
def leakage_query(spark, sf_dir):
    lines = scored_lines(spark, sf_dir)
    return leakage_audit(
        lines.where(F.col("score") < 0.8), lines.where(F.col("score") >= 0.8),
        ["l_quantity", "l_discount", "l_tax"], "l_partkey",
    )


@query("latency_summary", f"""WITH {EVE_SQL} SELECT count(*) AS n, round(avg(dur), 5) AS mean, round(stddev_pop(dur), 5) AS std,
  round(quantile_cont(dur, 0.5), 5) AS median, round(quantile_cont(dur, 0.99), 5) AS p99 FROM flows""")
def latency_query(spark, sf_dir):
    return rounded(latency_summary(flows(spark, sf_dir).withColumn("spent", duration_s()), "spent"), 5)
