"""Session calendars as column expressions."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class SessionCalendar(Protocol):
    def bars_per_year(self) -> float: ...
    def session_weekday(self, ts: Column) -> Column: ...
    def month_key(self, ts: Column) -> Column: ...
    def day_of_month(self, ts: Column) -> Column: ...
    def days_in_month(self, ts: Column) -> Column: ...


class UtcCalendar:
    """Sessions are UTC days."""

    def bars_per_year(self) -> float:
        return 252.0

    def session_weekday(self, ts: Column) -> Column:
        """Monday is 0."""
        return F.weekday(ts).cast("tinyint")

    def month_key(self, ts: Column) -> Column:
        return F.year(ts) * 12 + F.month(ts)

    def day_of_month(self, ts: Column) -> Column:
        return F.dayofmonth(ts)

    def days_in_month(self, ts: Column) -> Column:
        return F.dayofmonth(F.last_day(ts))


CALENDARS: dict[str, SessionCalendar] = {"UTC": UtcCalendar()}


def get_calendar(code: str) -> SessionCalendar:
    if code not in CALENDARS:
        raise KeyError(f"no calendar {code!r}; known: {', '.join(CALENDARS)}")
    return CALENDARS[code]
