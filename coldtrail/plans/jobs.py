"""Scheduled runs and refreshes over stored report tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..functions.links import DEFAULT_BASE, LinkBase
from ..functions.timebucket import as_datetime
from ..limits import Limits
from ..schema import REPORT_ENG, REPORT_TECH
from ..sources.sinks import append_window, read_between, read_report, replace_report, replace_window, window_is_loaded
from ..sources.tables import FleetTables
from .eng_report import eng_report, new_rows
from .fleet import ALL, EXCLUDED_COUNTRY
from .last_seen import last_seen
from .readers import Clock, eng_window, read_tech, tech_window, utc_now
from .tech_report import tech_report


def _stored_eng(spark: SparkSession, path: str, start, end, limits: Limits, but: dict[str, dt.date] | None = None) -> DataFrame:
    """Stored rows the guard can match: no event is older than the look-back of the detectors, or later than the window's day."""
    oldest = as_datetime(start) - dt.timedelta(days=limits.door_lookback_days + 1)
    return read_between(spark, path, REPORT_ENG, oldest, as_datetime(end) + dt.timedelta(days=1), but)


def populate_eng(t: FleetTables, path: str, start, end, country: str = ALL, interval: str = "Day", *, run_time=None,
                 limits: Limits = Limits(), excluded: str = EXCLUDED_COUNTRY, base: LinkBase = DEFAULT_BASE, clock: Clock = utc_now) -> None:
    """Append the rows that are not stored yet."""
    run_time = clock() if run_time is None else run_time
    rows = eng_report(t, start, end, country, interval, run_time=run_time, limits=limits, excluded=excluded, base=base)
    stored = _stored_eng(t.sensor.sparkSession, path, start, end, limits)
    append_window(new_rows(rows, stored), path, {"StartDate": as_datetime(start).date()}, "EventTime")


def run_weekly_eng(t: FleetTables, path: str, run_time=None, *, limits: Limits = Limits(),
                   excluded: str = EXCLUDED_COUNTRY, base: LinkBase = DEFAULT_BASE, clock: Clock = utc_now) -> None:
    """Replace the run's window, by default that of the current time; rows already stored under other windows are not repeated."""
    run_time = clock() if run_time is None else run_time
    start, end = eng_window(run_time)
    rows = eng_report(t, start, end, run_time=run_time, limits=limits, excluded=excluded, base=base)
    others = _stored_eng(t.sensor.sparkSession, path, start, end, limits, but={"StartDate": start})
    replace_window(new_rows(rows, others), path, {"StartDate": start}, "EventTime")


def _seen(t: FleetTables, path: str, start, state: str | None) -> DataFrame:
    return last_seen(t, state or f"{path.rstrip('/')}_last_seen", start)


def run_weekly_tech(t: FleetTables, path: str, run_date=None, *, limits: Limits = Limits(), excluded: str = EXCLUDED_COUNTRY,
                    base: LinkBase = DEFAULT_BASE, state: str | None = None, clock: Clock = utc_now) -> None:
    """The technician table holds one run only, by default that of the current time. ``state`` is the table of last readings, by
    default beside the report."""
    start, end = tech_window(clock() if run_date is None else run_date)
    rows = tech_report(t, start, end, limits=limits, excluded=excluded, base=base, seen=_seen(t, path, start, state))
    replace_report(rows, path, {"StartDate": start, "EndDate": end})


def refresh_tech(t: FleetTables, path: str, run_date=None, country: str = ALL, *, limits: Limits = Limits(), excluded: str = EXCLUDED_COUNTRY,
                 base: LinkBase = DEFAULT_BASE, state: str | None = None, clock: Clock = utc_now) -> None:
    """Rebuild the window for all countries, or load one country if it is absent."""
    start, end = tech_window(clock() if run_date is None else run_date)
    window = {"StartDate": start, "EndDate": end}
    args = {"limits": limits, "excluded": excluded, "base": base, "seen": _seen(t, path, start, state)}
    if country.strip().lower() == ALL.lower():
        replace_window(tech_report(t, start, end, **args), path, window)
        return
    stored = read_report(t.sensor.sparkSession, path, REPORT_TECH, window)
    if not window_is_loaded(stored, window, country):
        append_window(tech_report(t, start, end, country, **args), path, window)


def refreshed_tech(t: FleetTables, path: str, run_date=None, country: str = ALL, *, clock: Clock = utc_now, **options) -> DataFrame:
    """Refresh, then read without decimals in the value."""
    run_date = clock() if run_date is None else run_date
    refresh_tech(t, path, run_date, country, **options)
    start, end = tech_window(run_date)
    return read_tech(read_report(t.sensor.sparkSession, path, REPORT_TECH, {"StartDate": start, "EndDate": end}), run_date, country, version="1.0")
