"""Batch detection: scan, enrich, score, route, window, alert."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.enrich import enrich_flows
from ..operators.features import ENRICHED, assemble, flow_features, flow_meta, window_meta
from ..operators.ordering import MAX_GROUP_ROWS
from ..operators.scoring import (
    FAST_LABEL, STAGE_FLOW, STAGE_WINDOW, alert_record, decide, fast_path, gate_window,
)
from ..operators.windows import sessionize, sliding_behaviour, stack_window
from ..schema import DEFAULT_THRESHOLD, FLOW_CLASSES, SESSION_GAP_S, WINDOW_SIZE
from ..session import shared_dir

Score = Callable[[DataFrame], DataFrame]


def described_flows(events: DataFrame, order: Sequence[str] = ("seq",),
                    max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Flow rows with attachments, ``feat``, ``features``, ``meta`` and window columns."""
    rows = enrich_flows(events, order=order, max_rows=max_rows)
    return window_meta(flow_meta(assemble(flow_features(rows))))


def detect(
    events: DataFrame,
    score: Score,
    score_window: Score | None = None,
    adapt: Score | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    classes: Mapping[int, str] = FLOW_CLASSES,
    size: int = WINDOW_SIZE,
    gap_s: float = SESSION_GAP_S,
    order: Sequence[str] = ("seq",),
    ts: str = "timestamp",
    with_window: bool = False,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Alerts of a batch of events, nested as in :func:`alert_record`.

    ``score`` adds ``probs`` to rows with ``features``; ``adapt`` may rewrite
    ``features`` before it; ``score_window`` adds ``window_probs`` to rows with
    the eight behaviour columns (and ``window`` when ``with_window``).

    Flows below the threshold go before the source shuffle. What is left is
    checkpointed: it is a small part of the input, three plans read it, and
    the enrichment shuffle should run once.
    """
    rows = described_flows(events, order, max_rows)
    if adapt is not None:
        rows = adapt(rows)
    shared_dir(events.sparkSession)
    found = decide(score(rows), threshold=threshold, classes=classes)
    # Alerts and windows read the description, not the records behind it.
    spent = ["feat", "flow", "tcp", "http", "tls", "dns", *ENRICHED.values()]
    found = found.drop(*spent, *([] if with_window else ["features"])).checkpoint()
    quick = fast_path(len(classes) > 2)
    confidence = F.round("attack_prob", 4)
    fast = found.where(quick).select(
        *alert_record(F.lit(FAST_LABEL), confidence, F.lit(STAGE_FLOW))
    )
    slow = found.where(~quick)
    if score_window is None:
        return fast.unionByName(slow.select(
            *alert_record(F.col("xgb_label"), confidence, F.lit(STAGE_FLOW))
        ))
    sessions = sessionize(slow, ["src_ip"], ts, order, gap_s, max_rows)
    # The first rows of a session have no full window: the flow model decides.
    early = sessions.where(F.col("session_row") < size).select(
        *alert_record(F.col("xgb_label"), confidence, F.lit(STAGE_FLOW))
    )
    framed = sliding_behaviour(
        sessions, ["src_ip"], ts, size, chunk_rows=max_rows,
        collect={"flow_rows": "features"} if with_window else None,
    )
    if with_window:
        framed = stack_window(framed)
    gated = gate_window(score_window(framed)).select(
        *alert_record(F.col("window_label"), F.col("window_confidence"), F.lit(STAGE_WINDOW))
    )
    return fast.unionByName(early).unionByName(gated)
