"""Relabelling jobs: flows against ground truth, all scenarios in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import BOTNET_TERMS, mentions
from ..operators.labeling import (
    FIVE_TUPLE, apply_offset, clock_offset, default_label, five_tuple_key, nearest_label,
)
from ..operators.metrics import relabel_report
from ..operators.ordering import bounded


def flow_start(flows: DataFrame, into: str = "ts") -> DataFrame:
    """Time a flow is matched on: its start, else the event time."""
    return flows.withColumn(into, F.coalesce(F.col("flow.start"), F.col("timestamp")))


def relabel(
    flows: DataFrame,
    labels: DataFrame,
    scenario: str | None = "scenario",
    tolerance_s: float = 5.0,
    sync_clock: bool = False,
    assume: str | None = None,
    families: DataFrame | None = None,
) -> DataFrame:
    """Flows with ``gt_label`` (null when unmatched) by direction-free key and time.

    ``sync_clock`` estimates each scenario's clock offset first; ``assume``
    labels every flow of scenarios without ground truth; ``families`` adds the
    malware family per scenario.
    """
    keys: Sequence[str] = ([scenario] if scenario else []) + FIVE_TUPLE
    left, right = five_tuple_key(flow_start(flows)), five_tuple_key(labels)
    at = "ts"
    if sync_clock:
        if not scenario:
            raise ValueError("clock offsets are estimated per scenario")
        offsets = clock_offset(left, right, FIVE_TUPLE, scenario=scenario)
        left, at = apply_offset(left, offsets, "ts", scenario), "ts_aligned"
    found = nearest_label(left, right, keys, flow_ts=at, tolerance_s=tolerance_s)
    if assume is not None:
        found = default_label(found, labels, scenario, default=assume)
    if families is not None:
        found = found.join(bounded(families), scenario, "left").withColumn(
            "malware_family", F.coalesce("malware_family", F.lit("Bot"))
        )
    return found.drop(*FIVE_TUPLE)


def botnet_flows(relabelled: DataFrame, terms: Sequence[str] = BOTNET_TERMS) -> DataFrame:
    """The flows that ground truth calls botnet traffic."""
    return relabelled.where(mentions(F.col("gt_label"), terms))


def report(relabelled: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Per-scenario counts and a grand total, scenarios in order."""
    return relabel_report(relabelled, scenario).orderBy(F.col(scenario).asc_nulls_last())
