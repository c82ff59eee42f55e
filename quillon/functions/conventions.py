"""Rounding, calendar and order conventions, in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up_half(c: Column, digits: int = 2) -> Column:
    """Half goes up, towards plus infinity: -2.5 becomes -2 (unlike Spark's round, which goes away from zero)."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def round_half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def dow_sunday(d: Column | str) -> Column:
    """Sunday 0 to Saturday 6."""
    return (F.dayofweek(d) - 1).cast("int")


def dow_monday(d: Column | str) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(d).cast("int")


def week_start(ts: Column, zone: str = "UTC") -> Column:
    """The Monday of the week, in the zone, that holds a UTC time."""
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(ts, zone)))


def local_hour(ts: Column, zone: str) -> Column:
    return F.hour(F.from_utc_timestamp(ts, zone))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def median(c: str | Column) -> Column:
    """The exact median: the mean of the middle two."""
    return F.percentile(c, F.lit(0.5))


def order_statistic(values: Column, level: float) -> Column:
    """Conformal quantile of an array: the k-th least with k = min(ceil((n + 1) * level), n); null if it is empty."""
    n = F.size(values)
    k = F.least(F.ceil((n + 1) * F.lit(level)).cast("int"), n)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.greatest(k, F.lit(1))))
