"""The live loop: one streaming query from events to alerts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.features import assemble, flow_features, flow_meta, window_meta
from ..operators.scoring import (
    FAST_LABEL, STAGE_FLOW, STAGE_WINDOW, alert_record, decide, fast_path, gate_window,
)
from ..operators.windows import behaviour_of
from ..schema import DEFAULT_THRESHOLD, FLOW_CLASSES, SESSION_GAP_S, WINDOW_SIZE
from .state import stream_enrich, stream_windows

Score = Callable[[DataFrame], DataFrame]


def whole_windows(framed: DataFrame, full: Column, score_window: Score) -> DataFrame:
    """Full windows with the window model's verdict, the rest with nulls in its place.

    Two branches of one stateful output would run it twice, so the rows stay
    together: a row without a full window carries an empty list, which the
    model sees as zeros, and its answer is taken away again.
    """
    scored = gate_window(score_window(behaviour_of(framed)))
    return scored.withColumns({
        c: F.when(full, F.col(c)) for c in ("window_label", "window_confidence")
    })


def observe_progress(events: DataFrame, name: str = "progress") -> DataFrame:
    """Counters in every progress report: rows, flows, protocol records."""
    return events.observe(
        name, F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("event_type") == "flow").alias("flows"),
        F.count_if(F.col("event_type").isin("http", "tls", "dns")).alias("records"),
    )


def live_alerts(
    events: DataFrame, score: Score, score_window: Score,
    threshold: float = DEFAULT_THRESHOLD, classes: Mapping[int, str] = FLOW_CLASSES,
    size: int = WINDOW_SIZE, gap_s: float = SESSION_GAP_S, timeout_s: float = 300,
    fire: str = "slide", delay: str = "300 seconds", arrival: str | None = None,
) -> DataFrame:
    """Alert rows of a stream; the same stages as :func:`flowloom.plans.detect.detect`.

    A window that is not full yet gives a provisional alert from the flow
    model, a full one the window model's. A flow more than ``delay`` behind its id or its source is scored like any
    other, without records and outside the windows, so its alert is the flow
    model's too. ``arrival`` names a column of arrival times, see
    :func:`flowloom.streaming.state.stream_enrich`.
    """
    rows = stream_enrich(observe_progress(events), timeout_s, delay=delay, arrival=arrival)
    described = window_meta(flow_meta(assemble(flow_features(rows))))
    found = decide(score(described), threshold=threshold, classes=classes)
    found = found.withColumn("is_fast", fast_path(len(classes) > 2)).drop("feat")
    framed = stream_windows(
        found, size=size, gap_s=gap_s, fire=fire, fast="is_fast", delay=delay, partial=False
    )
    full = F.col("window_rows") == size
    gated = whole_windows(framed, full, score_window)
    confidence = F.round("attack_prob", 4)
    return gated.select(*alert_record(
        F.when(F.col("is_fast"), FAST_LABEL).when(full, F.col("window_label"))
        .otherwise(F.col("xgb_label")),
        F.when(full, F.col("window_confidence")).otherwise(confidence),
        F.when(full, STAGE_WINDOW).otherwise(STAGE_FLOW),
    ))
