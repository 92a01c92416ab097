"""One runnable query per operator on the driver's tables, with its SQL check."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import (  # noqa: F401
    flows, windows, joins, reports, samples, alignment, alerts, scans, streams, jobs,
)

__all__ = ["ORACLES", "QUERIES"]
