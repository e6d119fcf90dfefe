"""Columns for time axes: decimal years and their checks.

Timestamps are without a zone, so the session's zone never enters.  NULL in gives NULL out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_TOLERANCE = 1e-9  # relative difference from which two steps are distinct


def start_of_year(ts: Column, later: int = 0) -> Column:
    return F.make_timestamp_ntz(F.year(ts) + later, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


GREGORIAN = "proleptic_gregorian"
# Calendars whose years are all as long as each other, the days of their years and those before each month.
YEARS = {"noleap": 365, "all_leap": 366, "360_day": 360}
BEFORE_MONTH = {
    "noleap": (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334),
    "all_leap": (0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335),
    "360_day": (0, 30, 60, 90, 120, 150, 180, 210, 240, 270, 300, 330),
}
SAME = {"365_day": "noleap", "366_day": "all_leap", "gregorian": GREGORIAN, "standard": GREGORIAN}


class CalendarError(ValueError):
    """A calendar that is not known."""


def calendar_of(name: str) -> str:
    """A calendar by any of its names."""
    found = SAME.get(name, name)
    if found != GREGORIAN and found not in YEARS:
        raise CalendarError(f"unknown calendar {name!r}; known: {', '.join(sorted({GREGORIAN, *YEARS, *SAME}))}")
    return found


def days_in_month(year: Column, month: Column, calendar: str) -> Column:
    if calendar == GREGORIAN:
        return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    ends = [*BEFORE_MONTH[calendar][1:], YEARS[calendar]]
    return F.get(F.array(*(F.lit(b - a) for a, b in zip(BEFORE_MONTH[calendar], ends, strict=True))), month - 1)


def timestamp_of(year: Column, month: Column, day: Column, calendar: str) -> Column:
    """A timestamp that stands for a date: the date itself, or in a calendar of equal years the day of the same number since 1970.

    NULL for a date that the calendar does not have.
    """
    calendar = calendar_of(calendar)
    there = month.between(1, 12) & (day >= 1) & (day <= days_in_month(year, F.least(F.greatest(month, F.lit(1)), F.lit(12)), calendar))
    if calendar == GREGORIAN:
        return F.when(there, F.make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0)))
    number = (year - 1970) * YEARS[calendar] + F.get(F.array(*(F.lit(n) for n in BEFORE_MONTH[calendar])), month - 1) + day - 1
    return F.when(there, F.date_add(F.lit("1970-01-01").cast("date"), number.cast("int")).cast("timestamp_ntz"))


def decimal_year(ts: Column, calendar: str = GREGORIAN) -> Column:
    """Year plus the elapsed share of that year; in a calendar of equal years ``ts`` stands for a date as ``timestamp_of`` gives it."""
    if calendar_of(calendar) != GREGORIAN:
        days = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts).cast("double") / 86_400_000_000
        return days / YEARS[calendar_of(calendar)] + 1970
    first = start_of_year(ts)
    part = F.timestamp_diff("MICROSECOND", first, ts).cast("double") / F.timestamp_diff("MICROSECOND", first, start_of_year(ts, 1)).cast("double")
    return F.year(ts).cast("double") + part


def new_step(dt: Column, before: Column) -> Column:
    """Whether a step opens a cluster, given the next smaller one (NULL: none)."""
    return before.isNull() | (dt - before > STEP_TOLERANCE * F.greatest(F.abs(dt), F.abs(before)))
