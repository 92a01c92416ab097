"""Value clean-up: missing and zero are one value, as the feature set expects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def number(col: Column, default: float = 0.0) -> Column:
    """Double with a default for missing or unreadable values."""
    return F.coalesce(col.try_cast("double"), F.lit(default))


def whole(col: Column, default: int = 0) -> Column:
    """Integer with a default for missing or unreadable values."""
    return F.coalesce(col.try_cast("int"), F.lit(default))


def text(col: Column, default: str = "") -> Column:
    """String with a default for missing or empty values."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (also for null)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def finite(col: Column) -> Column:
    """NaN and both infinities become 0."""
    bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(col)


def clean_non_finite(df, columns):
    """Apply :func:`finite` to the given float columns or float-array columns."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({
        c: F.transform(F.col(c), finite) if isinstance(kinds[c], T.ArrayType) else finite(F.col(c))
        for c in columns
    })


def hex_value(col: Column) -> Column:
    """Integer value of a hexadecimal string; unreadable text counts as 0."""
    digits = F.regexp_replace(F.lower(F.trim(col)), "^0x", "")
    readable = digits.rlike("^[0-9a-f]{1,8}$")
    return F.coalesce(
        F.when(readable, F.conv(digits, 16, 10).cast("long")), F.lit(0).cast("long")
    )


def bit_flag(value: Column, mask: int) -> Column:
    return flag(value.bitwiseAND(F.lit(mask).cast("long")) != 0)


def digits_or_zero(col: Column) -> Column:
    """Port text: digits only, anything else is 0."""
    trimmed = F.trim(col)
    return F.when(
        trimmed.rlike("^[0-9]+$"), F.coalesce(trimmed.try_cast("int"), F.lit(0))
    ).otherwise(F.lit(0))
