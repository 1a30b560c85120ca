"""Technician report: one row per device and problem, with the device's state beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import DEFAULT_BASE, LinkBase, link_plain, link_range
from ..functions.timebucket import as_datetime, days_hours, epoch, epoch_of, ts_lit, window_days
from ..limits import Limits
from ..operators import tech
from ..operators.findings import TECH_COLUMNS
from ..operators.profile import fleet_profile
from ..operators.runs import last_compressor_run
from ..schema import REPORT_TECH
from ..sources.tables import FleetTables
from .fleet import ALL, EXCLUDED_COUNTRY, placed_fleet, placed_history_fleet
from .last_seen import newest
from .suppress import clear_offline_columns, only_missing_data_when_scarce, suppress

# Fixed value: chart slack of the weekly link in seconds.
SLACK = 28800

_COMMON = (
    "missing_data", *tech.SENSOR_PRESENCE, "low_mains_power", "low_solar_power", "battery_missing", "line_frequency",
    "refrigerant_leak", "solar_undersatisfied", "solar_no_ice", "low_temperature", "missing_power_board",
    "missing_control_board",
)


@dataclass(frozen=True)
class RuleSet:
    """What differs between the generations of the report."""

    detectors: tuple[str, ...]
    suppression: str
    by_country: bool
    latest_holdover: bool
    top_alone: bool
    supply: str
    data_rx_by_slot: bool
    ranged_link: bool
    drop_scarce: bool
    priority: bool


RULE_SETS = {
    "v4": RuleSet((*_COMMON, "missing_usb_board", "duplicate_device"), "v4", False, False, False, "supply_ok_legacy",
                  False, False, False, False),
    "v5": RuleSet((*_COMMON, "dirty_panels", "no_solar_power"), "v5", False, False, True, "supply_ok",
                  True, True, False, True),
    "v6": RuleSet((*_COMMON, "dirty_panels", "no_solar_power"), "v6", True, True, True, "supply_ok",
                  True, True, True, True),
}


def _state_counters(rules: RuleSet) -> set[str]:
    holdover = {"ctbh_last"} if rules.latest_holdover else {"ctbh_sum", "ctbh_n"}
    received = {"slots"} if rules.data_rx_by_slot else {"n"}
    return {"top_sum", "tvctopctl_n", "bottom_sum", "tvcbot_n", "last_time", _supply(rules)} | holdover | received


def _supply(rules: RuleSet) -> str:
    # the oldest rules use the wider legacy voltage range, which the solar counter has as well
    return "solar_ok" if rules.supply == "supply_ok_legacy" else "supply_ok"


def state_columns(rules: RuleSet, start, end, limits: Limits) -> list[str]:
    """Report columns computed from one profile row."""
    top, bottom = "try_divide(top_sum, tvctopctl_n)", "try_divide(bottom_sum, tvcbot_n)"
    both = f"({top} + {bottom}) / 2.0d"
    average = f"coalesce({both}, {bottom}, {top})" if rules.top_alone else f"coalesce({both}, if({top} is null, {bottom}, null))"
    expected = f"{limits.samples_per_day * window_days(start, end)!r}d"
    if rules.latest_holdover:
        holdover = "coalesce(cast(ctbh_last as decimal(6,1)), 0)"
    else:
        holdover = "coalesce(try_divide(ctbh_sum, ctbh_n), 0d)"
    received = tech.data_rx_pct(tech.Window(start, end)) if rules.data_rx_by_slot else f"coalesce(n, 0) / {expected} * 100.0d"
    return [
        f"cast({average} as decimal(8,1)) as TVCTOPCTLavg", f"cast({holdover} as decimal(6,1)) as CTBH",
        f"cast(coalesce({_supply(rules)}, 0) / {expected} * 100.0d as decimal(6,1)) as SLNX",
        f"cast({received} as decimal(6,1)) as DataRx"]


def data_age(last_time: Column, end) -> Column:
    return days_hours(F.lit(epoch_of(end)) - epoch(last_time))


def event_findings(t: FleetTables, start, end, limits: Limits) -> DataFrame:
    """Findings that need windows or the error log rather than counters."""
    return (
        tech.battery_drain(t, start, end, limits)
        .unionByName(tech.sd_card_errors(t, start, end, limits))
        .unionByName(tech.alarm_days(t, start, end))
        .unionByName(tech.mech_trips(t, start, end, limits))
        .unionByName(tech.long_door_open(t, start, end, limits)))


def tech_findings(t: FleetTables, devices: DataFrame, start, end, rules: str = "v6", limits: Limits = Limits(),
                  intended_precedence: bool = False) -> DataFrame:
    """Gated and suppressed findings of the listed devices, each with its device's columns and state."""
    chosen = RULE_SETS[rules]
    window = tech.Window(start, end)
    want = tech.needed_counters(chosen.detectors, limits, window) | _state_counters(chosen)
    profile = fleet_profile(devices, t, start, end, want, limits)
    # a device's counter findings go out with its first event finding, or alone
    events = event_findings(t, start, end, limits).selectExpr(
        "fridgeid", f"struct({', '.join(TECH_COLUMNS[1:])}, only_class) as event",
        "row_number() over (partition by fridgeid order by Message, Detail) as nth")
    state = [F.expr(column) for column in state_columns(chosen, start, end, limits)]
    counted = tech.rule_findings(chosen.detectors, limits, window)
    profile = profile.join(events, "fridgeid", "left").withColumn("counted", counted)
    found = "if(nth is null, counted, if(nth = 1, array_append(counted, event), array(event)))"
    rows = profile.select(*devices.columns, "last_time", *state, F.expr(f"inline({found})"))
    gated = rows.where(F.col("only_class").isNull() | (F.col("only_class") == F.col("fridgeType"))).drop("only_class")
    return suppress(gated, chosen.suppression, intended_precedence)


def tech_report(t: FleetTables, start, end, country: str = ALL, *, rules: str = "v6", limits: Limits = Limits(),
                excluded: str = EXCLUDED_COUNTRY, base: LinkBase = DEFAULT_BASE,
                intended_precedence: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """Report rows. ``seen`` has each device's last reading before the window (:func:`last_seen.last_seen`); without it all history
    before the window is read, one row per device and task."""
    chosen = RULE_SETS[rules]
    seen = newest(t, None, start) if seen is None else seen
    devices = placed_fleet(t, country, excluded) if chosen.by_country else placed_history_fleet(t, excluded)
    found = tech_findings(t, devices, start, end, rules, limits, intended_precedence)
    runs = last_compressor_run(t.sensor, start, end, limits)
    rows = found.join(runs, "fridgeid", "left").join(seen, "fridgeid", "left")
    if chosen.drop_scarce:
        rows = only_missing_data_when_scarce(rows, "device_id is not null")
    # class and link belong to the device record, as does the reported id
    device = F.col("device_id")
    solar = device.isNotNull() & (F.col("fridgeType") == "S")
    link = link_range(device, solar, ts_lit(start), ts_lit(end), SLACK, base) if chosen.ranged_link else link_plain(
        device, solar, base)
    columns = {
        "Priority": F.col("Priority") if chosen.priority else F.lit(None), "Country": F.col("country"),
        "StartDate": F.lit(as_datetime(start).date()), "EndDate": F.lit(as_datetime(end).date()),
        "ReportDays": F.lit(window_days(start, end)), "FridgeId": device, "FridgeShortSN": F.upper("FridgeShortSN"),
        "FridgeType": F.when(solar, "S").otherwise("M"), "Deployed": F.when(F.col("report") == 1, "Y"),
        "CompRunAgeMin": F.col("runAgeMin"), "CompRunAge": days_hours(F.col("runAgeMin") * 60),
        "DataAge": data_age(F.coalesce("last_time", "past_time"), end), "Link": link,
    }
    report = rows.select(*[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in REPORT_TECH])
    return clear_offline_columns(report)
