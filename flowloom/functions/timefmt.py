"""Timestamp parsing across the label and event formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Accepted patterns per source.
ARGUS_FORMATS = (
    "yyyy/MM/dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
)
LABEL_CSV_FORMATS = ("dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
ISO = "iso"


def parse_ts(
    col: Column,
    formats: Sequence[str] = (ISO,),
    tz: str | None = None,
    precision: str | None = None,
) -> Column:
    """First format that reads the text wins; unreadable text is null.

    ``tz`` names the zone of texts that carry no offset (default: the session
    zone, UTC); ``precision`` truncates, e.g. to ``"second"``.
    """
    trimmed = F.trim(col)
    tries = []
    for pattern in formats:
        if pattern == ISO:
            tries.append(F.try_to_timestamp(trimmed))
        else:
            naive = F.try_to_timestamp(trimmed, F.lit(pattern))
            tries.append(F.to_utc_timestamp(naive, tz) if tz else naive)
    parsed = F.coalesce(*tries)
    return F.date_trunc(precision, parsed) if precision else parsed


def micros(col: Column) -> Column:
    """Microseconds since the epoch, as bigint."""
    return F.unix_micros(col.cast("timestamp"))


def minute_of_day(col: Column) -> Column:
    """UTC minute of the day, 0-1439."""
    return F.pmod(F.floor(micros(col) / F.lit(60_000_000)), F.lit(1440)).cast("int")
