"""Calendar buckets and boundary-counting date differences as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = ("Minute", "10Minute", "Hour", "Day", "Week")


def as_datetime(value: dt.date | dt.datetime | str) -> dt.datetime:
    """A window bound as a naive UTC datetime rounded to the second."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    elif not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return (value + dt.timedelta(microseconds=500_000)).replace(microsecond=0)


def epoch_of(value: dt.date | dt.datetime | str) -> int:
    return int((as_datetime(value) - dt.datetime(1970, 1, 1)).total_seconds())


def ts_lit(value: dt.date | dt.datetime | str) -> Column:
    """The bound as a timestamp literal (UTC), foldable and pushed down to the scan."""
    return F.timestamp_seconds(F.lit(epoch_of(value)))


def round_second(ts: Column) -> Column:
    return F.date_trunc("second", ts + F.expr("interval 500 milliseconds"))


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts)


def week_label(ts: Column) -> Column:
    """Sunday-to-Saturday weeks, labelled by their Friday."""
    day = F.to_date(ts)
    return F.date_add(F.date_sub(day, F.dayofweek(day) - 1), 5).cast("timestamp")


def bucket(ts: Column, interval: str) -> Column:
    if interval == "Week":
        return week_label(ts)
    if interval == "10Minute":
        return F.timestamp_seconds(slot_number(ts, 600) * 600)
    if interval in INTERVALS:
        return F.date_trunc(interval.lower(), ts)
    raise ValueError(f"unknown interval {interval!r}; known: {', '.join(INTERVALS)}")


def slot_number(ts: Column, seconds: int) -> Column:
    """Ordinal of the fixed-length slot: a long, cheaper to group by than a timestamp."""
    return F.floor(epoch(ts) / seconds)


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def boundary_diff(unit: str, earlier: Column, later: Column) -> Column:
    """Number of unit boundaries crossed between two timestamps (not elapsed units)."""
    seconds = _UNIT_SECONDS[unit]
    return slot_number(later, seconds) - slot_number(earlier, seconds)


def window_minutes(start, end) -> int:
    return epoch_of(end) // 60 - epoch_of(start) // 60


def window_days(start, end) -> int:
    return epoch_of(end) // 86400 - epoch_of(start) // 86400


def days_hours(seconds: Column) -> Column:
    """Age text such as ``3d 7h``; the exact wording is a choice of this library."""
    whole = F.floor(seconds / 86400)
    hours = F.floor((seconds - whole * 86400) / 3600)
    return F.concat(whole.cast("string"), F.lit("d "), hours.cast("string"), F.lit("h"))


def report_time(ts: Column) -> Column:
    return F.date_format(ts, "dd-MMM-yyyy HH:mm:ss")
