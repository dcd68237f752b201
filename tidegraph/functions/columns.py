"""Small expressions over columns and arrays."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_unused(numbers: Column) -> Column:
    """The smallest non-negative integer that an array lacks."""
    return F.array_min(F.array_except(F.sequence(F.lit(0), F.size(numbers)), numbers.cast("array<int>")))


def percentile_at(values: Column, p: float) -> Column:
    """Element at index int(p / 100 * n) of the sorted array; with an odd n the mean of it and the one before; none: 0."""
    a, n = F.array_sort(values), F.size(values)
    k = F.floor(n * F.lit(p / 100)).cast("int")
    at = lambda i: F.get(a, i)
    return F.when(n == 0, F.lit(0.0)).when(n == 1, at(F.lit(0))).when(n % 2 == 0, at(k)).otherwise((at(F.greatest(k - 1, F.lit(0))) + at(k)) / 2)


def close_to(a: Column, b: Column, within: float = 0.001) -> Column:
    return F.abs(a - b) < within


def day(seconds: Column) -> Column:
    """yyyy-MM-dd of epoch seconds, UTC sessions."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def rfc3339(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def live_at(ts: Column, end_ts: Column, at) -> Column:
    """True if the half-open interval [ts, end_ts) holds `at`; a null end is open."""
    return (ts <= at) & (end_ts.isNull() | (end_ts > at))
