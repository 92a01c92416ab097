"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from flowloom.catalog import QUERIES

HEADLINE = (
    "flow_features", "enriched_features", "sessionize", "sliding_behaviour", "window_labels",
    "tumbling_windows", "nearest_label", "nearest_label_five_tuple", "folded_time_label",
    "degraded_key_label", "interval_label", "rule_label", "operating_curve", "pr_curve",
    "class_report", "model_matrix", "sample_per_class", "stratified_split", "group_split",
    "window_quota", "scale_apply", "covariance", "coral_transform", "alerts", "scan_eve",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("flowloom-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's compilers and the Python workers.
    QUERIES["flow_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begin, 3)
        print(name, timings[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
