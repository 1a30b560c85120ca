"""Which devices a report covers, and where each of them stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_text
from ..operators.findings import device_flags
from ..sources.tables import FleetTables

ALL = "All"
# Fixed value: devices of this country are left out of reports on all countries.
EXCLUDED_COUNTRY = "China"
PLACE = ["country", "L1", "L3", "commDte", "report"]


def latest_location(history: DataFrame) -> DataFrame:
    """Newest history row of each device, combined map-side."""
    newest = history.groupBy("fridgeid").agg(F.max(F.struct("createddtm", "location_id", *PLACE)).alias("newest"))
    return newest.select("fridgeid", *[F.col(f"newest.{c}").alias(c) for c in ("createddtm", *PLACE)])


def elsewhere(country: Column, excluded: str) -> Column:
    return ~same_text(country, excluded)


def _flagged(rows: DataFrame, t: FleetTables) -> DataFrame:
    """Devices that are no freezers, with their class."""
    flagged = rows.join(device_flags(t.device_group), "fridgeid", "left").where("not coalesce(is_freezer, false)")
    return flagged.withColumn("fridgeType", F.expr("if(is_solar, 'S', 'M')")).drop("is_solar", "is_freezer")


def _named(rows: DataFrame, t: FleetTables) -> DataFrame:
    """Add the device record; ``device_id`` is NULL where there is none."""
    return rows.join(t.device.select("fridgeid", F.col("fridgeid").alias("device_id"), "FridgeShortSN"), "fridgeid", "left")


def eng_location(t: FleetTables, excluded: str = EXCLUDED_COUNTRY) -> DataFrame:
    """Newest place outside the excluded country: filtered before ranking."""
    newest = latest_location(t.location_history.where(elsewhere(F.col("country"), excluded)))
    return _flagged(newest, t).select("fridgeid", "createddtm", *PLACE)


def placed_fleet(t: FleetTables, country: str = ALL, excluded: str = EXCLUDED_COUNTRY) -> DataFrame:
    """Devices by their latest place: all but one country, or one country; no freezers."""
    country = country.strip()
    place = F.col("country")
    chosen = elsewhere(place, excluded) if country.lower() == ALL.lower() else same_text(place, country)
    return _named(_flagged(latest_location(t.location_history).where(chosen), t), t).select(
        "fridgeid", "device_id", "FridgeShortSN", "fridgeType", *PLACE)


def fleet(t: FleetTables, country: str = ALL, excluded: str = EXCLUDED_COUNTRY) -> DataFrame:
    return placed_fleet(t, country, excluded).select("fridgeid", "FridgeShortSN", "fridgeType")


def located_fleet(t: FleetTables, country: str = ALL, excluded: str = EXCLUDED_COUNTRY) -> DataFrame:
    """The fleet with its newest place outside the excluded country. In a report on all countries the latest place of a device lies
    outside of it, so the history is read once."""
    chosen = placed_fleet(t, country, excluded)
    if country.strip().lower() != ALL.lower():
        chosen = chosen.drop(*PLACE).join(eng_location(t, excluded).select("fridgeid", "country", "L1", "L3"), "fridgeid", "left")
    return chosen.select("fridgeid", "FridgeShortSN", "fridgeType", "country", "L1", "L3")


def history_fleet(t: FleetTables, excluded: str = EXCLUDED_COUNTRY) -> DataFrame:
    """Older choice: every device that ever stood outside the excluded country."""
    rows = t.location_history.where(elsewhere(F.col("country"), excluded)).select("fridgeid").distinct()
    return _flagged(rows, t)


def placed_history_fleet(t: FleetTables, excluded: str = EXCLUDED_COUNTRY) -> DataFrame:
    placed = history_fleet(t, excluded).join(latest_location(t.location_history), "fridgeid", "left")
    return _named(placed, t).select("fridgeid", "device_id", "FridgeShortSN", "fridgeType", *PLACE)
