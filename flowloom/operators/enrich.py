"""Attach protocol records to the flow that follows them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from .features import ENRICHED
from .ordering import MAX_GROUP_ROWS, _attach, running_totals, split_heavy

RECORD_TYPES = ("http", "tls", "dns")


def _empty(kind: T.DataType) -> Column:
    """A non-null struct of nulls: the record exists but says nothing."""
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind])


def enrich_flows(
    events: DataFrame,
    key: str = "flow_id",
    order: Sequence[str] = ("seq",),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Flow rows with the first http, tls and dns record seen before them.

    A flow consumes what was collected for its id; records after it belong to
    the next flow with that id. The epoch of a row is the number of flows with
    its id before it, so a flow and its records share an epoch. Rows without a
    usable id (null or 0) are never joined, and are spread so that they do not
    meet in one task.
    """
    kinds = {f.name: f.dataType for f in events.schema}
    known = F.col(key).isNotNull() & (F.col(key) != 0)
    is_flow = F.col("event_type") == "flow"
    rows = events.where(is_flow | (F.col("event_type").isin(*RECORD_TYPES) & known))
    # One group per row where the id is unusable.
    rows = rows.withColumn("__lone", F.when(known, F.lit(0)).otherwise(F.xxhash64(*order)))
    keys = [key, "__lone"]
    records = {
        kind: F.when(
            (F.col("event_type") == kind),
            F.coalesce(F.col(kind), _empty(kinds[kind])),
        )
        for kind in RECORD_TYPES
    }

    light, heavy = split_heavy(rows, keys, max_rows, among=known)
    parts = []
    if light is not None:
        past = (
            Window.partitionBy(*keys).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        epoch = F.coalesce(F.count_if(is_flow).over(past), F.lit(0).cast("long"))
        upto = (
            Window.partitionBy(*keys, "__epoch").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        parts.append(
            light.withColumn("__epoch", epoch)
            .withColumns({
                ENRICHED[k]: F.first(v, ignorenulls=True).over(upto)
                for k, v in records.items()
            })
            .where(is_flow)
        )
    if heavy is not None:
        counted = running_totals(
            heavy, keys, [F.col(c) for c in order],
            {"__flows": is_flow.cast("long")}, max_rows,
        ).withColumn("__epoch", F.col("__flows") - is_flow.cast("long"))
        # Partial min_by per id and epoch: a long epoch is reduced map-side.
        place = F.struct(*order)
        first = counted.where(~is_flow).groupBy(*keys, "__epoch").agg(*[
            F.min_by(v, F.when(F.col("event_type") == k, place)).alias(ENRICHED[k])
            for k, v in records.items()
        ])
        parts.append(
            _attach(counted.where(is_flow), first, [*keys, "__epoch"], "left")
        )
    wanted = [*events.columns, *ENRICHED.values()]
    out = parts[0].select(*wanted)
    for part in parts[1:]:
        out = out.unionByName(part.select(*wanted))
    return out
