"""Report time windows, all in UTC, all derived from an explicit ``as_of``.

``as_of`` replaces every wall-clock read so a report is reproducible.  The
date-string ``BETWEEN start AND end`` of the source application ends at
00:00 of the end day (quirk Q3); ``between_dates`` keeps that meaning and
callers choose it explicitly.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple


class Window(NamedTuple):
    start: dt.datetime | None
    end: dt.datetime | None
    end_inclusive: bool = False


def to_datetime(v) -> dt.datetime:
    if isinstance(v, dt.datetime):
        return v
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    return dt.datetime.fromisoformat(str(v))


def to_date(v) -> dt.date:
    return to_datetime(v).date()


def midnight(v) -> dt.datetime:
    d = to_date(v)
    return dt.datetime(d.year, d.month, d.day)


def day(v) -> Window:
    """DATE(created_at) = v, as a half-open range (pushable)."""
    s = midnight(v)
    return Window(s, s + dt.timedelta(days=1))


def week_start(as_of) -> dt.datetime:
    """Monday 00:00 of the ISO week holding ``as_of`` (DATE_TRUNC('week'))."""
    s = midnight(as_of)
    return s - dt.timedelta(days=s.weekday())


def week(start) -> Window:
    s = midnight(start)
    return Window(s, s + dt.timedelta(days=7))


def since_week_start(as_of) -> Window:
    """created_at >= DATE_TRUNC('week', now): no upper bound."""
    return Window(week_start(as_of), None)


def month_start(as_of) -> dt.datetime:
    d = to_date(as_of)
    return dt.datetime(d.year, d.month, 1)


def since_month_start(as_of) -> Window:
    return Window(month_start(as_of), None)


def month(year: int, month_: int) -> Window:
    """EXTRACT(YEAR)=y AND EXTRACT(MONTH)=m, as a half-open range."""
    s = dt.datetime(year, month_, 1)
    e = dt.datetime(year + (month_ == 12), month_ % 12 + 1, 1)
    return Window(s, e)


def between_dates(start, end) -> Window:
    """created_at BETWEEN 'start' AND 'end' with date strings: both ends at 00:00 (Q3)."""
    return Window(midnight(start), midnight(end), True)


def last_30_days(as_of) -> Window:
    """Default range of the period reports: 30 days before as_of to as_of's date."""
    t = to_datetime(as_of)
    return between_dates((t - dt.timedelta(days=30)).date(), t.date())


def ts_lit(v):
    """timestamp_ntz literal from text (no session or local time zone involved)."""
    from pyspark.sql import functions as F
    return F.lit(to_datetime(v).isoformat(sep=" ")).cast("timestamp_ntz")


def bills_in(t, w: Window, status: str | None = "completed"):
    return t.bills_window(w.start, w.end, w.end_inclusive, status=status)
