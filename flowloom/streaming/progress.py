"""Totals over the micro-batches of a running query, its observed metrics included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class ProgressTotals:
    """Counters that outlive single progress reports.

    A report covers one micro-batch and Spark keeps the last hundred or so;
    :meth:`absorb` adds those not seen yet. ``totals`` holds the sum of every
    observed metric as ``observation.metric``, ``input_rows``, ``batches`` and
    ``busy_ms``, the time spent in micro-batches. Restarts of a query from its
    checkpoint go on counting: batches are told apart by run and number.
    """

    def __init__(self) -> None:
        self.totals: dict[str, int] = {"batches": 0, "input_rows": 0, "busy_ms": 0}
        self._seen: set[tuple[str, int]] = set()

    def absorb(self, query: StreamingQuery) -> None:
        for report in query.recentProgress:
            # A report without a duration of its batch is a sign of life between batches.
            key = (str(report.runId), report.batchId)
            if key in self._seen or "addBatch" not in report.durationMs:
                continue
            self._seen.add(key)
            metrics = {
                f"{name}.{metric}": value for name, row in report.observedMetrics.items()
                for metric, value in row.asDict().items()
            }
            own = {"batches": 1, "input_rows": report.numInputRows,
                   "busy_ms": report.durationMs.get("triggerExecution", 0)}
            for name, value in (metrics | own).items():
                self.totals[name] = self.totals.get(name, 0) + int(value or 0)

    def follow(self, query: StreamingQuery, every_s: float = 1.0) -> ProgressTotals:
        """Absorb reports until the query ends; its error, if any, is raised."""
        while not query.awaitTermination(every_s):
            self.absorb(query)
        self.absorb(query)
        return self

    @property
    def rows_per_second(self) -> float:
        """Throughput while batches ran."""
        return self.totals["input_rows"] * 1000 / max(self.totals["busy_ms"], 1)

    def table(self, spark: SparkSession) -> DataFrame:
        """``counter, value``: one row per total."""
        return spark.createDataFrame(sorted(self.totals.items()), "counter string, value long")
