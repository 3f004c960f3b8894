"""Named date ranges."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

PRESETS = ("LAST_7_DAYS", "LAST_30_DAYS", "LAST_90_DAYS", "THIS_MONTH", "LAST_MONTH", "THIS_YEAR", "CUSTOM")


def months_back(day: date, months: int) -> date:
    """The same day so many months earlier, or that month's last."""
    year, month = divmod(day.year * 12 + day.month - 1 - months, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def preset(name: str, as_of: date, start: date | None = None, end: date | None = None) -> tuple[date, date]:
    """First and last day of a named range that ends at as_of; CUSTOM takes its own."""
    first = as_of.replace(day=1)
    if name == "LAST_MONTH":
        last = first - timedelta(days=1)
        return last.replace(day=1), last
    if name == "CUSTOM":
        if start is None or end is None or start > end:
            raise ValueError("a custom range takes a start and an end that is not before it")
        return start, end
    days = {"LAST_7_DAYS": 7, "LAST_30_DAYS": 30, "LAST_90_DAYS": 90}
    if name in days:
        return as_of - timedelta(days=days[name] - 1), as_of
    starts = {"THIS_MONTH": first, "THIS_YEAR": first.replace(month=1)}
    if name not in starts:
        raise ValueError(f"no such range: {name}")
    return starts[name], as_of
