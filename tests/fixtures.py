"""Hand-built fleets: only the columns a test names are set."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from coldtrail import schema
from coldtrail.sources.tables import FleetTables

T0 = dt.datetime(2024, 1, 7)  # a Sunday
WEEK = (T0, T0 + dt.timedelta(days=7))


def at(seconds: float = 0, *, minutes: float = 0, hours: float = 0, days: float = 0) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds, minutes=minutes, hours=hours, days=days)


def frame(spark, struct, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(row.get(name) for name in struct.names) for row in rows], struct)


def make_fleet(spark, *, sensor=(), errors=(), bad_time=(), history=(), devices=(), groups=()) -> FleetTables:
    readings = [{"reading_id": i, **row} for i, row in enumerate(sensor)]
    return FleetTables(
        sensor=frame(spark, schema.SENSOR, readings),
        errors=frame(spark, schema.ERRORS, list(errors)),
        bad_time_errors=frame(spark, schema.BAD_TIME_ERRORS, list(bad_time)),
        location_history=frame(spark, schema.LOCATION_HISTORY, list(history)),
        device=frame(spark, schema.DEVICE, [{"fridgeid": d, "FridgeShortSN": f"sn{d}"} for d in devices]),
        device_group=frame(spark, schema.DEVICE_GROUP, [{"fridgeid": d, "GroupName": g} for d, g in groups]),
    )


def reading(device: int, when: dt.datetime, **values) -> dict:
    doubles = {k: float(v) if v is not None and k not in ("SCPX", "SCPS", "ICPS", "SLNX", "SDXC") else v for k, v in values.items()}
    return {"fridgeid": device, "measureddtm": when, **doubles}


def error(device: int, when: dt.datetime, code: str, message: str = "0(1)") -> dict:
    return {"fridgeid": device, "id": code, "description": f"about {code}", "message": message, "measureddtm": when}


def place(device: int, country: str, when: dt.datetime = T0, number: int = 0, report: int = 0) -> dict:
    return {"fridgeid": device, "createddtm": when, "location_id": number, "country": country, "L1": "a", "L3": "b",
            "commDte": when.date(), "report": report}
