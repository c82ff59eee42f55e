"""Time windows of reports and schedules."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve(now: datetime, *, hours: int | None = None, since: str | None = None, until: str | None = None, most_hours: int = 24 * 31, forward: bool = False) -> tuple[datetime, datetime, bool]:
    """(start, end, trimmed) of rolling hours or of a range, never both.

    A window that is too long loses its early part; a forward schedule loses its far part.
    """
    if (hours is None) == (since is None and until is None):
        raise ValueError("give either hours or a range")
    if hours is not None:
        if hours <= 0:
            raise ValueError("hours must be positive")
        start, end = (now, now + timedelta(hours=hours)) if forward else (now - timedelta(hours=hours), now)
    else:
        start = datetime.fromisoformat(since) if since else now if forward else datetime.fromisoformat(until) - timedelta(hours=most_hours)
        end = datetime.fromisoformat(until) if until else start + timedelta(hours=most_hours) if forward else now
    if end <= start:
        raise ValueError("the end must come after the start")
    limit = timedelta(hours=most_hours)
    if end - start <= limit:
        return start, end, False
    return (start, start + limit, True) if forward else (end - limit, end, True)


def within(at: Column, start: datetime, end: datetime, *, closed: bool = False) -> Column:
    """[start, end), or [start, end] where closed."""
    a, b = (F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") for x in (start, end))
    return (at >= a) & ((at <= b) if closed else (at < b))
