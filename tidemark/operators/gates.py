"""When a day's data may be used, kept as evidence, or fetched: predicates over a session's day and an instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From when a day's data are whole, and from when a running session forbids fetching.
EOD_READY, SESSION_OPEN = "15:30:00", "09:30:00"


def _clock(now: Column) -> Column:
    return F.date_format(now, "HH:mm:ss")


def _work_day(day: Column) -> Column:
    return F.weekday(day) < 5


def current_ready(day: Column, now: Column) -> Column:
    """The day is today, and its data are whole."""
    return (day == F.to_date(now)) & (_clock(now) >= EOD_READY)


def closed_ready(day: Column, now: Column) -> Column:
    """The day is over: before today, or today with whole data."""
    return (day < F.to_date(now)) | current_ready(day, now)


def next_work_day(day: Column) -> Column:
    """The day after, or the Monday after a week-end; holidays are not known here."""
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def forward_ready(day: Column, now: Column) -> Column:
    """Evidence of the day may be frozen: from its close until the next working day opens."""
    at = lambda d, clock: F.to_timestamp(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(f" {clock}")), "yyyy-MM-dd HH:mm:ss")
    instant = now.cast("timestamp")
    return (at(day, EOD_READY) <= instant) & (instant < at(next_work_day(day), SESSION_OPEN))


def fetch_blocked(now: Column) -> Column:
    """A session is running, so that its unfinished data would be stored as whole."""
    return _work_day(F.to_date(now)) & (_clock(now) >= SESSION_OPEN) & (_clock(now) < EOD_READY)


def latest_complete(days: Column, now: Column) -> Column:
    """Of a sorted array of days the last one that is over; the only day where there is no other."""
    over = F.filter(days, lambda d: closed_ready(d, now))
    return F.coalesce(F.array_max(over), F.array_max(days))
