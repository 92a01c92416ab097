"""Counts, reports, threshold curves and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import BOTNET_TERMS, traffic_kind
from .ordering import MAX_GROUP_ROWS, bounded, running_totals

#: Keeps a rate defined when a side is empty.
TINY = 1e-10


def _share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole with a value for an empty whole."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(empty))


# Counts ---------------------------------------------------------------------


def run_counters(events: DataFrame, is_alert: Column) -> DataFrame:
    """One row: flows seen, alerts, benign flows, skipped records.

    Protocol records feed the enrichment and are neither counted nor skipped;
    unreadable lines and other record types are skipped.
    """
    kind = F.coalesce(F.col("event_type"), F.lit(""))
    flow = kind == "flow"
    return events.agg(
        F.count_if(flow).alias("total"),
        F.count_if(flow & is_alert).alias("alerts"),
        F.count_if(flow & ~is_alert).alias("benign"),
        F.count_if(~kind.isin("flow", "http", "tls", "dns")).alias("skipped"),
    )


def counts_by(df: DataFrame, *cols: str, into: str = "n") -> DataFrame:
    """Row counts per value, most frequent first."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(into)).orderBy(F.col(into).desc(), *cols)


def relabel_report(
    df: DataFrame, scenario: str = "scenario", label: str = "gt_label",
    terms: Sequence[str] = BOTNET_TERMS,
) -> DataFrame:
    """Flows, matches and kinds per scenario, plus a grand total (null scenario)."""
    kind = traffic_kind(F.col(label), terms)
    counted = df.rollup(scenario).agg(
        F.count(F.lit(1)).alias("flows"),
        F.count(label).alias("matched"),
        F.count_if(kind == "botnet").alias("botnet"),
        F.count_if(kind == "normal").alias("normal"),
        F.count_if(kind == "background").alias("background"),
        F.count_if(kind == "unmatched").alias("unmatched"),
    )
    return counted.withColumn("match_pct", _share(F.col("matched") * 100.0, F.col("flows")))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percent per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class reaches this window.
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def class_weights(
    df: DataFrame, label: str = "label", classes: Sequence | None = None
) -> DataFrame:
    """Balanced weight ``n / (k * n_c)`` per class; listed absent classes get 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    weights = counts.withColumn(
        "weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    )
    if classes is None:
        return weights
    kind = df.schema[label].dataType
    listed = df.sparkSession.createDataFrame([(c,) for c in classes], [label]).select(
        F.col(label).cast(kind)
    )
    return listed.join(weights, label, "left").select(
        label, F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"),
    )


def attach_weights(df: DataFrame, weights: DataFrame, label: str = "label",
                   into: str = "weight") -> DataFrame:
    """Row weight from the per-class table."""
    return df.join(bounded(weights.select(label, F.col("weight").alias(into))), label)


def compare_counts(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """Label counts of two runs over the union of their labels, and the difference."""
    def counts(df: DataFrame, into: str) -> DataFrame:
        return df.groupBy(label).agg(F.count(F.lit(1)).alias(into))

    joined = counts(before, "before").join(counts(after, "after"), label, "full")
    filled = joined.na.fill(0, ["before", "after"])
    return filled.withColumn("difference", F.col("after") - F.col("before"))


def dominant_label(
    df: DataFrame, group: Sequence[str], label: str, into: str = "dominant"
) -> DataFrame:
    """Most frequent label per group; equal counts go to the smallest label."""
    counts = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("__n"))
    # Negated count: the minimum is the largest count, then the smallest label.
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(label).alias("l")))
    return counts.groupBy(*group).agg(best["l"].alias(into))


# Classification metrics -----------------------------------------------------


def binary_metrics(df: DataFrame, truth: Column, flagged: Column) -> DataFrame:
    """Confusion counts, false-alarm rate and recall of a binary decision."""
    counts = df.agg(
        F.count_if(truth & flagged).alias("tp"), F.count_if(~truth & flagged).alias("fp"),
        F.count_if(truth & ~flagged).alias("fn"), F.count_if(~truth & ~flagged).alias("tn"),
    )
    return counts.withColumns({
        "far": F.col("fp") / (F.col("fp") + F.col("tn") + TINY),
        "recall": F.col("tp") / (F.col("tp") + F.col("fn") + TINY),
    })


def recall_at(
    df: DataFrame, label: str, score: str, threshold: float, benign
) -> DataFrame:
    """Detection rate per attack class with the macro and pooled overall rate."""
    hits = (
        df.where(F.col(label) != F.lit(benign)).groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= threshold).alias("detected"))
    )
    every = Window.partitionBy()
    rate = F.col("detected") / F.col("n")
    return hits.withColumns({
        "recall": rate,
        "macro_recall": F.avg(rate).over(every),
        "pooled_recall": F.sum("detected").over(every) / F.sum("n").over(every),
    })


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the pair counts."""
    pairs = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("__n"))
    n, none = F.col("__n"), F.lit(0).cast("long")
    same = F.col(truth) == F.col(predicted)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col(truth).alias("c"), n.alias("support"), none.alias("claimed"),
                 F.when(same, n).otherwise(none).alias("tp")),
        F.struct(F.col(predicted).alias("c"), none.alias("support"), n.alias("claimed"),
                 none.alias("tp")),
    )).alias("s"))
    totals = sides.groupBy(F.col("s.c").alias("class")).agg(
        F.sum("s.support").alias("support"), F.sum("s.claimed").alias("claimed"),
        F.sum("s.tp").alias("tp"),
    )
    rated = totals.withColumns({
        "precision": _share(F.col("tp"), F.col("claimed")),
        "recall": _share(F.col("tp"), F.col("support")),
    })
    both = F.col("precision") + F.col("recall")
    return rated.withColumn(
        "f1", _share(2 * F.col("precision") * F.col("recall"), both)
    ).drop("claimed")


def report_summary(report: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1 of a class report."""
    return report.agg(
        _share(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        _share(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("support"),
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """One row per true class, one count column per predicted class."""
    return df.groupBy(truth).pivot(predicted, list(classes)).count().na.fill(0)


# Threshold curves -----------------------------------------------------------


def pr_curve(
    df: DataFrame, truth: Column, score: str, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Precision and recall at every distinct score, as ``score >= threshold``.

    Rows are reduced to distinct scores before anything is ordered. ``area``
    is the trapezoid between a point and the next higher threshold, so the sum
    is the PR-AUC; the curve starts at recall 0 with precision 1.
    """
    points = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(truth).alias("__pos"), F.count_if(~truth).alias("__neg"),
    )
    cum = running_totals(
        points, [], [F.col("threshold").desc()],
        {"tp": F.col("__pos"), "fp": F.col("__neg")}, max_rows,
    )
    tp, fp = F.col("tp"), F.col("fp")
    tp_before, fp_before = tp - F.col("__pos"), fp - F.col("__neg")
    cum = cum.withColumns({
        "precision": tp / (tp + fp),
        "recall": _share(tp, F.col("tp_all"), 1.0),
        "__p": _share(tp_before, tp_before + fp_before, 1.0),
        "__r": _share(tp_before, F.col("tp_all")),
    })
    area = (F.col("recall") - F.col("__r")) * (F.col("precision") + F.col("__p")) / 2
    return cum.withColumn("area", area).select(
        "threshold", "tp", "fp", "precision", "recall", "area"
    )


def pr_auc(curve: DataFrame) -> DataFrame:
    return curve.agg(F.sum("area").alias("pr_auc"))


def threshold_for_recall(curve: DataFrame, min_recall: float = 0.95, default: float = 0.5) -> DataFrame:
    """Most precise threshold that keeps the recall; the lowest one on a tie."""
    return curve.where(F.col("recall") >= min_recall).agg(
        F.coalesce(
            F.max_by("threshold", F.struct(F.col("precision"), -F.col("threshold"))),
            F.lit(default),
        ).alias("threshold")
    )


def grid(start_hundredths: int, stop_hundredths: int, step_hundredths: int = 1) -> list[float]:
    """Thresholds as exact hundredths, e.g. ``grid(50, 99)``."""
    return [i / 100 for i in range(start_hundredths, stop_hundredths + 1, step_hundredths)]


def linear_grid(start: float, stop: float, points: int) -> list[float]:
    step = (stop - start) / (points - 1)
    return [start + step * i for i in range(points)]


def thresholds_met(score: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds the score reaches.

    On an even grid the place is computed and then corrected against the
    neighbouring thresholds, so a long grid costs no more than a short one.
    """
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    n = len(thresholds)
    step = (thresholds[-1] - thresholds[0]) / (n - 1) if n > 1 else 0.0
    even = step > 0 and all(
        abs(t - (thresholds[0] + step * i)) < step / 4 for i, t in enumerate(thresholds)
    )
    if not even:
        return F.size(F.filter(limits, lambda t: score >= t))
    guess = F.least(F.greatest(
        F.floor((score - thresholds[0]) / F.lit(step)).cast("int"), F.lit(0)
    ), F.lit(n - 1))
    met = (
        F.when(score < F.get(limits, guess), guess)
        .when((guess < n - 1) & (score >= F.get(limits, guess + 1)), guess + 2)
        .otherwise(guess + 1)
    )
    return F.coalesce(met, F.lit(0))


def operating_curve(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float], benign,
    attacks: Sequence,
) -> DataFrame:
    """False alarms and detection rates at every threshold, from one pass.

    Every score is reduced to the number of thresholds it reaches; classes and
    grid places are then few, and the curve is a sum over places.
    """
    places = df.select(
        F.col(label).alias("__c"), thresholds_met(F.col(score), thresholds).alias("__met")
    ).groupBy("__c", "__met").agg(F.count(F.lit(1)).alias("__n"))
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    dense = places.select("__c", "__met", "__n", F.posexplode(limits).alias("__i", "threshold"))
    reached = F.when(F.col("__met") > F.col("__i"), F.col("__n")).otherwise(0)

    def total(of: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, of)), F.lit(0).cast("long"))

    is_benign = F.col("__c") == F.lit(benign)
    rates = {
        str(a): _share(total(reached, F.col("__c") == F.lit(a)),
                       total(F.col("__n"), F.col("__c") == F.lit(a)))
        for a in attacks
    }
    listed = F.col("__c").isin(*attacks)
    return dense.groupBy("threshold").agg(
        total(reached, is_benign).alias("false_alarms"),
        _share(total(reached, is_benign), total(F.col("__n"), is_benign)).alias("far"),
        *[c.alias(f"recall_{a}") for a, c in rates.items()],
        _share(total(reached, listed), total(F.col("__n"), listed)).alias("pooled_recall"),
        (sum(rates.values(), F.lit(0.0)) / len(rates)).alias("macro_recall"),
    )


def threshold_for_far(
    curve: DataFrame, max_far: float = 0.01, recall: str = "pooled_recall", default: float = 0.5
) -> DataFrame:
    """Best recall below the false-alarm limit; the lowest threshold on a tie."""
    fit = curve.where((F.col("far") < max_far) & (F.col(recall) > 0))
    return fit.agg(
        F.coalesce(
            F.max_by("threshold", F.struct(F.col(recall), -F.col("threshold"))), F.lit(default)
        ).alias("threshold"),
        F.coalesce(F.max(recall), F.lit(0.0)).alias("recall"),
    )


def first_threshold_within(
    curve: DataFrame, limit_pct: float, default: float, strict: bool = False
) -> DataFrame:
    """Lowest threshold whose false-alarm percent is within the limit."""
    pct = F.col("far") * 100.0
    fits = pct < limit_pct if strict else pct <= limit_pct
    return curve.where(fits).agg(F.coalesce(F.min("threshold"), F.lit(default)).alias("threshold"))


def model_matrix(
    scores: DataFrame, attacks: Sequence, benign, model: str = "model", label: str = "label",
    score: str = "score", threshold: str = "threshold",
) -> DataFrame:
    """Model by class detection rates and false-alarm rate."""
    flagged = F.col(score) >= F.col(threshold)

    def rate(where: Column) -> Column:
        return F.avg(F.when(where, flagged.cast("double")))

    return scores.groupBy(model).agg(
        *[rate(F.col(label) == F.lit(a)).alias(f"recall_{a}") for a in attacks],
        rate(F.col(label) != F.lit(benign)).alias("recall_all"),
        rate(F.col(label) == F.lit(benign)).alias("far"),
    )


def adaptation_effect(df: DataFrame, before: str, after: str, threshold: float) -> DataFrame:
    """False-positive rates on benign target rows before and after adaptation."""
    hit_before, hit_after = F.col(before) >= threshold, F.col(after) >= threshold
    rates = df.agg(
        F.count(F.lit(1)).alias("n_target"),
        F.count_if(hit_before).alias("fp_count_before"),
        F.count_if(hit_after).alias("fp_count_after"),
    ).withColumns({
        "fp_before": _share(F.col("fp_count_before"), F.col("n_target")),
        "fp_after": _share(F.col("fp_count_after"), F.col("n_target")),
    })
    return rates.withColumn("improvement_pct", _share(
        (F.col("fp_before") - F.col("fp_after")) * 100.0, F.col("fp_before")
    ))


def end_to_end_recall(inputs: DataFrame, alerts: DataFrame, label: str = "label") -> DataFrame:
    """Alerts over input rows per class."""
    total = inputs.groupBy(label).agg(F.count(F.lit(1)).alias("total"))
    found = alerts.groupBy(label).agg(F.count(F.lit(1)).alias("alerts"))
    joined = total.join(found, label, "left").na.fill(0, ["alerts"])
    return joined.withColumn("recall_pct", F.col("alerts") * 100.0 / F.greatest("total", F.lit(1)))


# Audits ---------------------------------------------------------------------


def source_concentration(df: DataFrame, label: str = "label", source: str = "src_ip") -> DataFrame:
    """Share of each class that its most frequent source contributes."""
    counts = df.groupBy(label, source).agg(F.count(F.lit(1)).alias("__n"))
    best = F.max(F.struct(F.col("__n"), F.col(source)))
    return counts.groupBy(label).agg(
        F.sum("__n").alias("n"), F.count(F.lit(1)).alias("sources"),
        best["__n"].alias("top_n"), best[source].alias("top_source"),
    ).withColumn("top_share", F.col("top_n") / F.col("n"))


def leakage_audit(
    train: DataFrame, holdout: DataFrame, signature: Sequence[str], source: str = "src_ip"
) -> DataFrame:
    """Holdout rows whose signature, or whose source, also occurs in training.

    Keys are compared by value, not by a hash, so the counts are exact.
    """
    def marked(df: DataFrame, keys: Sequence[str], into: str) -> DataFrame:
        seen = train.select(*keys).distinct().withColumn(into, F.lit(1))
        return df.join(seen, list(keys), "left")

    both = marked(marked(holdout, signature, "__sig"), [source], "__src")
    return both.agg(
        F.count(F.lit(1)).alias("holdout_rows"),
        F.count("__sig").alias("same_signature"),
        F.count("__src").alias("same_source"),
    )


def latency_summary(
    df: DataFrame, value: str, percentiles: Mapping[str, float] | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Mean, population std and exact interpolated percentiles of a duration.

    Percentiles come from running counts over the distinct values; no task
    holds all values.
    """
    wanted = percentiles or {"median": 0.5, "p99": 0.99}
    distinct = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    cum = running_totals(distinct, [], [F.col("__v")], {"__upto": F.col("__n")}, max_rows)
    last = F.col("__upto_all") - 1

    def at(index: Column) -> Column:
        """Smallest value whose running count passes the 0-based index."""
        return F.min(F.when(F.col("__upto") > index, F.col("__v")))

    aggs = []
    for name, q in wanted.items():
        place = last * F.lit(q)
        aggs += [
            at(F.floor(place)).alias(f"__lo_{name}"),
            at(F.ceil(place)).alias(f"__hi_{name}"),
            F.first(place - F.floor(place)).alias(f"__part_{name}"),
        ]
    out = cum.agg(*aggs)
    basic = df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
    )
    # Two one-row results side by side.
    joined = basic.withColumn("__k", F.lit(1)).join(out.withColumn("__k", F.lit(1)), "__k")
    return joined.select("n", "mean", "std", *[
        (F.col(f"__lo_{m}") + (F.col(f"__hi_{m}") - F.col(f"__lo_{m}")) * F.col(f"__part_{m}")).alias(m)
        for m in wanted
    ])
