"""Reading stored reports for a run date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_text
from ..functions.timebucket import as_datetime, report_time
from .fleet import ALL


Clock = Callable[[], dt.datetime]


def utc_now() -> dt.datetime:
    """The time a job or reader takes where none is given."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _day(run_date, offset: int) -> dt.date:
    return as_datetime(run_date).date() + dt.timedelta(days=offset)


def eng_window(run_date) -> tuple[dt.date, dt.date]:
    return _day(run_date, -7), _day(run_date, 1)


def tech_window(run_date) -> tuple[dt.date, dt.date]:
    return _day(run_date, -8), _day(run_date, -1)


def _of_country(rows: DataFrame, country: str) -> DataFrame:
    return rows if country.strip().lower() == ALL.lower() else rows.where(same_text(F.col("Country"), country))


def read_eng(report: DataFrame, run_date=None, country: str = ALL, *, clock: Clock = utc_now) -> DataFrame:
    """Engineering rows of the week before (the current time by default), formatted and in report order."""
    run_date = clock() if run_date is None else run_date
    rows = _of_country(report.where(F.col("StartDate") == F.lit(eng_window(run_date)[0])), country)
    message = F.col("Message")
    link = F.when(message.like("DAQ%") | message.like("Failed%Start%"), F.col("GLink")).otherwise(F.col("Link"))
    order = ["L1", "L3", "FridgeId"]
    if country.strip().lower() == ALL.lower():
        order = ["Country", *order]
    # ordered before the projection: EventTime becomes text there
    return rows.orderBy(*order).select(
        "Country", "L1", "L3", "StartDate", "EndDate", "ReportDays", "FridgeId", "FridgeShortSN", "FridgeType", "Message",
        "Detail", "value", report_time(F.col("EventTime")).alias("EventTime"), "RecCount", link.alias("Link"),
        "MessageInterval")


def read_tech(report: DataFrame, run_date=None, country: str = ALL, version: str = "1.1", *, clock: Clock = utc_now) -> DataFrame:
    """Technician rows of the window (of the current time by default); version 1.0 shows the value without decimals."""
    start, end = tech_window(clock() if run_date is None else run_date)
    rows = _of_country(report.where((F.col("StartDate") == F.lit(start)) & (F.col("EndDate") == F.lit(end))), country)
    digits = {"1.1": 1, "1.0": 0}[version]
    shown = {
        "value": f"decimal(8,{digits})", "TVCTOPCTLavg": "decimal(8,1)", "CTBH": "decimal(8,0)", "SLNX": "decimal(8,0)",
        "DataRx": "decimal(8,0)"}
    return rows.select(*[F.col(c).cast(shown[c]).alias(c) if c in shown else F.col(c) for c in rows.columns])


def rows_per_start(report: DataFrame) -> DataFrame:
    return report.groupBy("StartDate").agg(F.count(F.lit(1)).alias("rows"))
