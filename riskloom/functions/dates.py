"""Date helpers: event date text, Monday weeks, lookback bounds."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_sqldate(c, on_error: str = "raise") -> Column:
    """``yyyyMMdd`` text to DATE. ``on_error='raise'`` fails on bad text (ANSI),
    ``on_error='null'`` gives NULL instead."""
    if on_error == "raise":
        return F.to_date(_col(c), "yyyyMMdd")
    if on_error == "null":
        return F.try_to_date(_col(c), "yyyyMMdd")
    raise ValueError("on_error must be 'raise' or 'null'")


def week_of(c) -> Column:
    """Monday of the ISO week holding the date (DATE, not TIMESTAMP)."""
    return F.trunc(_col(c), "week")


def as_date(as_of) -> _dt.date:
    if isinstance(as_of, _dt.datetime):
        return as_of.date()
    if isinstance(as_of, _dt.date):
        return as_of
    return _dt.date.fromisoformat(str(as_of))


def lookback_start(as_of, months: int) -> Column:
    """First date kept: ``add_months(week_of(as_of), months)`` (months is negative).

    The reference date is an argument, never the clock, so reruns are repeatable.
    """
    return F.add_months(F.trunc(F.lit(as_date(as_of)), "week"), int(months))
