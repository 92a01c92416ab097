"""Statistics of short arrays (one count window), as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run_ends(ordered: Column) -> Column:
    """1-based positions where a run of equal values ends in a sorted array."""
    n = F.size(ordered)
    return F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == n) | (F.get(ordered, i - 1) != F.get(ordered, i)),
    )


def run_lengths(values: Column) -> Column:
    """How often each distinct value of a non-empty array occurs.

    Sorting once and differencing run ends costs n log n per array, where
    counting every value against every other one costs n squared.
    """
    ends = _bound(F.sort_array(values), _run_ends)
    return _bound(ends, lambda e: F.zip_with(
        e,
        F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1)),
        lambda end, begin: end - begin,
    ))


def entropy(values: Column) -> Column:
    """Shannon entropy in bits; 0 for an empty array."""
    n = F.size(values)
    bits = F.aggregate(
        run_lengths(values),
        F.lit(0.0),
        lambda acc, c: acc - (c / n) * F.log2(c / n),
    )
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def modal_share(values: Column) -> Column:
    """Count of the most frequent value over the length; 0 for an empty array."""
    n = F.size(values)
    return F.when(n > 0, F.array_max(run_lengths(values)) / n).otherwise(F.lit(0.0))


def reuse_ratio(values: Column) -> Column:
    """One minus the share of distinct values; 0 for an empty array."""
    n = F.size(values)
    return F.when(n > 0, 1.0 - F.size(F.array_distinct(values)) / n).otherwise(F.lit(0.0))


def present(values: Column) -> Column:
    """Drop null and empty strings."""
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))
