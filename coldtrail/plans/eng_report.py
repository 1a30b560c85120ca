"""Engineering report: event-level findings of the whole fleet."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import DEFAULT_BASE, LinkBase
from ..functions.timebucket import as_datetime, ts_lit, window_days
from ..limits import Limits
from ..operators import eng
from ..operators.edges import charge_frame, edge_power, trip_frames
from ..operators.findings import render_classed
from ..schema import REPORT_ENG
from ..sources.tables import FleetTables
from .fleet import ALL, EXCLUDED_COUNTRY, located_fleet


def eng_findings(t: FleetTables, start, end, interval: str = "Day", limits: Limits = Limits()) -> DataFrame:
    """All detectors of the report, unrendered; only some follow the caller's interval.

    The sensor series is read four times: by the rules over single readings, by the
    edges, by the values beside error codes, and for openings before the window
    (five times where events are listed one by one).
    """
    edges = edge_power(t.sensor, start, end, [*trip_frames(limits), charge_frame(limits)])
    parts = [
        eng.point_findings(t, start, end, interval, limits),
        eng.edge_findings(edges, interval, limits),
        eng.daq_errors(t, start, end, "Week", limits),
        eng.failed_starts(t, start, end, "Week", limits),
    ]
    return reduce(DataFrame.unionByName, parts)


def eng_report(t: FleetTables, start, end, country: str = ALL, interval: str = "Day", *, run_time: dt.datetime | str,
               limits: Limits = Limits(), excluded: str = EXCLUDED_COUNTRY, base: LinkBase = DEFAULT_BASE) -> DataFrame:
    """Report rows before the insert guard."""
    devices = located_fleet(t, country, excluded).withColumn("is_solar", F.col("fridgeType") == "S")
    rows = render_classed(eng_findings(t, start, end, interval, limits).join(devices, "fridgeid"), base,
                          carry=("FridgeShortSN", "fridgeType", "country", "L1", "L3"))
    columns = {
        "CreatedDtm": ts_lit(run_time), "Country": F.col("country"),
        "StartDate": F.lit(as_datetime(start).date()), "EndDate": F.lit(as_datetime(end).date()),
        "ReportDays": F.lit(window_days(start, end)), "FridgeId": F.col("fridgeid"),
        "FridgeShortSN": F.upper("FridgeShortSN"), "FridgeType": F.col("fridgeType"), "Link": F.col("link"),
        "GLink": F.col("Glink"),
    }
    return rows.select(*[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in REPORT_ENG])


def new_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose device, time and count are not stored yet.

    The message takes no part, and a row without a time never matches, so it is
    inserted again by every run.
    """
    keys = ["FridgeId", "EventTime", "RecCount"]
    return rows.join(stored.select(*keys), keys, "left_anti")
