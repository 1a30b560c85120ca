"""Rules that drop findings made redundant by another finding of the same device.

Each rule sees the result of the one before it. Windows hold one device's findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Messages of the technician report that the rules name.
OFFLINE = "Unit Offline"
MISSING_DATA = "Missing Data"
POWER_BOARD = "Missing Power Board Data"
MAINS_POWER = "Low Mains Power Availability"
FREQUENCY = "Line Frequency Abnormal"
NO_SOLAR = "Solar Power Disconnected"
LOW_SOLAR = "Low Solar Power"


def _is(*names: str) -> str:
    return "Message in (" + ", ".join(f"'{name}'" for name in names) + ")"


def _drop(rows: DataFrame, device_has: str, doomed: str) -> DataFrame:
    """Delete ``doomed`` rows, where ``has`` says whether the device has a matching finding."""
    flag = f"fridgeid is not null and max(coalesce({device_has}, false)) over (partition by fridgeid) as has"
    return rows.selectExpr("*", flag).where(f"not coalesce({doomed}, false)").drop("has")


def mark_offline(rows: DataFrame) -> DataFrame:
    silent = f"coalesce({_is(MISSING_DATA)} and value = 0, false)"
    return rows.withColumns({
        "Message": F.expr(f"if({silent}, '{OFFLINE}', Message)"), "Detail": F.expr(f"if({silent}, null, Detail)"),
        "value": F.expr(f"if({silent}, null, value)")})


def only_offline(rows: DataFrame) -> DataFrame:
    return _drop(rows, _is(OFFLINE), f"has and not {_is(OFFLINE)}")


def drop_power_without_board(rows: DataFrame, intended_precedence: bool = False) -> DataFrame:
    """Power findings of devices without power-board data.

    Literally the condition reads ``(device and mains) or frequency``, which drops
    every frequency finding; ``intended_precedence`` limits both to the device.
    """
    no_board = f"{_is(POWER_BOARD)} and value < 1"
    if intended_precedence:
        return _drop(rows, no_board, f"has and {_is(MAINS_POWER, FREQUENCY)}")
    return _drop(rows, no_board, f"has and {_is(MAINS_POWER)} or {_is(FREQUENCY)}")


def drop_frequency_without_power(rows: DataFrame) -> DataFrame:
    return _drop(rows, f"{_is(MAINS_POWER)} and value < 1", f"has and {_is(FREQUENCY)}")


def drop_low_solar_when_disconnected(rows: DataFrame) -> DataFrame:
    return _drop(rows, _is(NO_SOLAR), f"has and {_is(LOW_SOLAR)}")


def only_mains_without_board(rows: DataFrame) -> DataFrame:
    """Oldest rule set: devices without power-board data keep the mains finding alone."""
    return _drop(rows, f"{_is(POWER_BOARD)} and value < 1", f"has and not {_is(MAINS_POWER)}")


def suppress(rows: DataFrame, rules: str = "v6", intended_precedence: bool = False) -> DataFrame:
    rows = only_offline(mark_offline(rows))
    if rules == "v4":
        return only_mains_without_board(rows)
    rows = drop_power_without_board(rows, intended_precedence)
    return drop_low_solar_when_disconnected(drop_frequency_without_power(rows))


def clear_offline_columns(rows: DataFrame) -> DataFrame:
    """Holdover and supply columns say nothing about an offline device."""
    return rows.withColumns({c: F.expr(f"if({_is(OFFLINE)}, null, {c})") for c in ("CTBH", "SLNX")})


def only_missing_data_when_scarce(rows: DataFrame, listed: str = "true") -> DataFrame:
    """Devices with some data but less than one percent keep the missing-data finding alone, if they are ``listed``."""
    return _drop(rows, "DataRx > 0 and DataRx < 1", f"has and {listed} and not {_is(MISSING_DATA)}")
