"""Training windows: sessions, labels, class quota, matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import MAX_GROUP_ROWS
from ..operators.sampling import window_quota
from ..operators.windows import attack_classes, label_windows, sessionize, window_tensor
from ..schema import SESSION_GAP_S, WINDOW_SIZE
from ..session import shared_dir


def window_dataset(
    flows: DataFrame,
    keys: Sequence[str] = ("file", "src_ip"),
    label: str = "label",
    classes: Sequence[int] | None = None,
    ts: str = "ts",
    order: Sequence[str] = ("seq",),
    size: int = WINDOW_SIZE,
    stride: int = 1,
    gap_s: float = SESSION_GAP_S,
    total_cap: int | None = None,
    position: Column | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``group_id``, ``label``, ``window`` of the attack windows, all of them by default.

    ``total_cap`` shares a quota out over the classes, which default to all
    labels in the data. Labels and quota work on narrow rows; then only the blocks
    of rows that chosen windows touch are kept, and matrices are built from those,
    so that no matrix is shuffled. The session table is checkpointed because both sides
    read it.
    """
    keys = list(keys)
    shared_dir(flows.sparkSession)
    sessions = sessionize(flows, keys, ts, order, gap_s, max_rows).checkpoint()
    group = F.concat_ws("|", *keys)
    if classes is None:
        classes = attack_classes(sessions, label)
    labelled = label_windows(
        sessions.select(*keys, label, "session", "session_row"), keys, label, classes,
        size=size, stride=stride, chunk_rows=max_rows,
    ).withColumn("group_id", group)
    chosen = labelled if total_cap is None or not classes else window_quota(
        labelled, "group_id", "window_label", total_cap // len(classes),
        ["session", "session_row"], position=position, max_rows=max_rows,
    )
    place = [*keys, "session", "session_row"]
    chosen = chosen.select(*place, "group_id", F.col("window_label").alias("chosen_label")).checkpoint()
    # A window lies in the block of ``size`` rows that it ends in and the one before.
    block = F.floor((F.col("session_row") - 1) / F.lit(size)).cast("long")
    members = chosen.select(
        *keys, "session", F.explode(F.array(block - 1, block)).alias("__block")
    ).distinct()
    rows = sessions.withColumn("__block", block).join(
        members, [*keys, "session", "__block"], "left_semi"
    ).drop("__block").join(chosen, place, "left")
    tensors = window_tensor(rows, keys, ts, size=size, stride=stride, chunk_rows=max_rows)
    return tensors.where(F.col("chosen_label").isNotNull()).select(
        "group_id", F.col("chosen_label").alias("label"), "window", "session", "session_row"
    )
