"""Detectors of the weekly technician report: at most one finding per device and rule."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import before_space, has_parenthesis, inside_parentheses, to_count
from ..functions.timebucket import window_days, window_minutes
from ..limits import Limits
from ..sources.tables import FleetTables, error_rows
from .asof import next_day_pairs
from .edges import edge_power, tech_start_frame, tech_stop_frame, trip_frames
from .findings import TECH_COLUMNS
from .islands import bucket_islands
from .profile import fleet_profile

# Error codes.
ALARM_CODES = ("4406", "6402")
SD_CARD_CODES = ("6782", "6784", "6301", "630D")
DOOR_CODES = ("5404",)


@dataclass(frozen=True)
class Window:
    start: object
    end: object

    @property
    def minutes(self) -> int:
        return window_minutes(self.start, self.end)

    @property
    def days(self) -> int:
        return window_days(self.start, self.end)


@dataclass(frozen=True)
class Rule:
    """A finding computed from the counters of one profile row; the parts are SQL."""

    priority: str | None
    message: str
    detail: str
    needs: tuple[str, ...]
    value: str
    holds: str
    errors: str = "null"
    only: str | None = None


def fixed(sql: str, precision: int = 8, scale: int = 1) -> str:
    """Rounded half away from zero, as a double."""
    return f"cast(cast({sql} as decimal({precision},{scale})) as double)"


def data_rx_pct(w: Window) -> str:
    """Share of ten-minute slots with data, unrounded."""
    return f"(cast(slots as double) / {w.minutes / 10.0!r}d * 100.0d)"


def _pct(part: str, whole: str) -> str:
    return f"if({whole} = 0, 0d, cast({part} as double) / cast({whole} as double) * 100.0d)"


def _share(counter: str, base: str) -> str:
    return f"coalesce({fixed(_pct(counter, base))}, 0d)"


def _available(counter: str, w: Window, limits: Limits) -> str:
    return fixed(f"cast({counter} as double) / {w.minutes * limits.samples_per_day / 1440.0!r}d * 100.0d")


def rules(limits: Limits, w: Window) -> dict[str, Rule]:
    def control(counter: str, message: str, detail: str) -> Rule:
        share = _share(counter, "scpx_n")
        return Rule("Low", message, detail, ("n", "scpx_n", counter), share,
                    f"{share} < {limits.present_pct} and scpx_n > {limits.control_min_rows}", f"n - {counter}")

    def data_ok(counter: str, priority: str, message: str, only: str | None = None) -> Rule:
        share = _pct(f"coalesce({counter}, 0)", "n")
        return Rule(priority, message, "Data OK %", ("n", counter), fixed(share), f"{share} < {limits.present_pct}", only=only)

    def availability(counter: str, message: str, limit: float, only: str) -> Rule:
        pct = _available(counter, w, limits)
        return Rule("Medium", message, "Power OK %", (counter,), pct, f"{pct} < {limit}", only=only)

    received = fixed(data_rx_pct(w))
    tamdaq, holdover = _share("tamdaq_n", "n"), _share("ctbh_n", "n")
    both_ice = f"greatest({_share('ticmctl_n', 'scpx_n')}, {_share('ticbkctl_n', 'scpx_n')})"
    brightest = fixed("pv_max", 6, 0)
    hz_ok = f"if(volt_ok = 0, 0d, 100.0d - {_pct('hz_bad', 'volt_ok')})"
    volt_out = f"if(evln_n = 0, 0d, 100.0d - {_pct('volt_ok', 'evln_n')})"
    slnx = f"slnx_on / {limits.samples_per_day * w.days!r}d * 100.0d"
    leak_free = f"(100.0d - {_pct('leak_low', 'leak_all')})"
    states = ("state_6", "state_2")
    return {
        "missing_data": Rule("Low", "Missing Data", "Data Rx %", ("slots",), received, f"{received} < {limits.data_rx_pct}"),
        "usb_board": Rule("Medium", "USB Board - Control Sensor Error", "TAMDAQ OK %", ("n", "tamdaq_n"), tamdaq,
                          f"{tamdaq} < {limits.present_pct}", "n - tamdaq_n"),
        "control_sensor": control("tvctopctl_n", "Control Sensor Error", "TVCTOPCTL OK %"),
        "ice_sensor": control("ticmctl_n", "Ice Sensor Error", "TICMCTL OK %"),
        "ice_backup_sensor": control("ticbkctl_n", "Ice Sensor Error", "TICBKCTL OK %"),
        "no_holdover": Rule("Low", "No Calculated Holdover", "Check Sensor Errors", ("n", "ctbh_n"), holdover,
                            f"{holdover} < {limits.holdover_pct}"),
        "both_ice_sensors": Rule(
            "Medium", "Both Ice Sensors Missing Error", "Control OK %", ("scpx_n", "ticmctl_n", "ticbkctl_n"), both_ice,
            f"{both_ice} < {limits.both_ice_pct} and scpx_n > {limits.control_min_rows}"),
        "low_mains_power": availability("mains_ok", "Low Mains Power Availability", limits.mains_ok_pct, "M"),
        "low_solar_power": availability("solar_ok", "Low Solar Power Availability", limits.solar_ok_pct, "S"),
        "dirty_panels": Rule("Low", "Low Solar Power", "Max EWDCA", ("pv_max",), brightest,
                             f"{brightest} < {limits.dirty_panel_w}", only="S"),
        "no_solar_power": Rule("Medium", "Solar Power Disconnected", "Data Rx %", ("pv_on", "slots"), fixed(data_rx_pct(w), 6, 0),
                               f"pv_on = 0 and {data_rx_pct(w)} > {limits.zero_pv_rx_pct}", only="S"),
        "battery_missing": Rule("Medium", "Battery Missing Error", "1-hour Max Batt < .2 v", ("battery_hours",), "null",
                                "battery_hours > 0", "battery_hours"),
        "line_frequency": Rule(
            "Medium", "Line Frequency Abnormal", "In Range %", ("volt_ok", "hz_bad", "evln_n", "slnx_on"), fixed(hz_ok),
            f"volt_ok > 1 and {hz_ok} < {limits.hz_ok_pct} and {volt_out} > {limits.hz_volt_out_pct} "
            f"and {slnx} < {limits.hz_power_ok_pct}", f"floor({volt_out})"),
        "refrigerant_leak": Rule("High", "Possible refrigerant leak", "Compressor Power %", ("leak_low", "leak_all"),
                                 fixed(leak_free), f"{leak_free} < {limits.leak_pct}", only="M"),
        "solar_undersatisfied": Rule("Low", "Solar Fridge Low Ice", "Undersatisfied", states, "null",
                                     "state_6 > 1 and state_2 = 0", only="S"),
        "solar_no_ice": Rule("Medium", "Solar Fridge Low Ice", "Not Enough Ice", states, "null",
                             "state_6 = 0 and state_2 = 0", only="S"),
        "low_temperature": Rule("High", "Low Temperature Alert", "Days (Count)", ("low_days",), "low_days", "low_days > 0"),
        "low_temperature_any": Rule("High", "Low Temperature Alert", "Days (Count)", ("low_any_days",), "low_any_days",
                                    "low_any_days > 0"),
        "missing_power_board": data_ok("evln_n", "Medium", "Missing Power Board Data", "M"),
        "missing_control_board": data_ok("scpx_n", "Low", "Missing Control Board Data"),
        "missing_usb_board": data_ok("tamdaq_n", "Medium", "Missing USB Board Data"),
        "missing_holdover": data_ok("ctbh_n", "Low", "Missing CTBH"),
        "duplicate_device": Rule(None, "Data Error", "Duplicate FridgeId", ("duplicate_days",), "null",
                                 "duplicate_days > 0", "duplicate_days"),
    }


SENSOR_PRESENCE = ("usb_board", "control_sensor", "ice_sensor", "ice_backup_sensor", "no_holdover", "both_ice_sensors")


def needed_counters(names: Iterable[str], limits: Limits, w: Window) -> set[str]:
    known = rules(limits, w)
    return {counter for name in names for counter in known[name].needs}


def _quoted(value: str | None) -> str:
    return "cast(null as string)" if value is None else f"'{value}'"


def rule_findings(names: Iterable[str], limits: Limits, w: Window) -> Column:
    """Array of the findings that hold on a profile row."""
    known = rules(limits, w)

    def finding(rule: Rule) -> str:
        return (f"if({rule.holds}, struct({_quoted(rule.priority)} as Priority, '{rule.message}' as Message, "
                f"'{rule.detail}' as Detail, cast({rule.value} as double) as value, cast({rule.errors} as int) as errCnt, "
                f"{_quoted(rule.only)} as only_class), null)")

    return F.expr(f"array_compact(array({', '.join(finding(known[name]) for name in names)}))")


def profile_findings(profile: DataFrame, names: Iterable[str], start, end, limits: Limits = Limits()) -> DataFrame:
    return profile.select("fridgeid", F.inline(rule_findings(names, limits, Window(start, end))))


def detect(names: str | Iterable[str], t: FleetTables, devices: DataFrame, start, end, limits: Limits = Limits()) -> DataFrame:
    """Run profile rules for the listed devices (without class gates)."""
    names = [names] if isinstance(names, str) else list(names)
    want = needed_counters(names, limits, Window(start, end))
    profile = fleet_profile(devices.select("fridgeid"), t, start, end, want, limits)
    return profile_findings(profile, names, start, end, limits).select(*TECH_COLUMNS)


def data_rx(t: FleetTables, devices: DataFrame, start, end, limits: Limits = Limits()) -> DataFrame:
    """Data Rx % column of every listed device."""
    profile = fleet_profile(devices.select("fridgeid"), t, start, end, {"slots"}, limits)
    return profile.selectExpr("fridgeid", f"cast({data_rx_pct(Window(start, end))} as decimal(6,1)) as dataRx")


def tech_rows(rows: DataFrame, priority: str | None, message: str, detail: Column | str | None, value: Column | None,
              errors: Column | None = None, only: str | None = None) -> DataFrame:
    text = detail if isinstance(detail, Column) else F.lit(detail).cast("string")
    return rows.select(
        "fridgeid", F.lit(priority).cast("string").alias("Priority"), F.lit(message).alias("Message"), text.alias("Detail"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if errors is None else errors).cast("int").alias("errCnt"), F.lit(only).cast("string").alias("only_class"))


def battery_drain(t: FleetTables, start, end, limits: Limits = Limits()) -> DataFrame:
    """Devices whose worst change of charge over a day is below the limit."""
    worst = next_day_pairs(t.sensor, start, end, limits).groupBy("fridgeid").agg(F.min("battDiff").alias("worst"))
    return tech_rows(worst.where(F.col("worst") < limits.drain_limit), "Low", "Fast Battery Drain", None, None)


def first_battery_pair(t: FleetTables, start, end, limits: Limits = Limits()) -> DataFrame:
    """Earliest pair of readings a day apart, with both charges."""
    pairs = next_day_pairs(t.sensor, start, end, limits)
    columns = ("endDtm", "startDtm", "battStart", "battEnd", "battDiff")
    first = pairs.groupBy("fridgeid").agg(F.min(F.struct(*columns)).alias("p"))
    w = [F.lit(str(x)).cast("timestamp").cast("date") for x in (start, end)]
    return first.select(
        "fridgeid", w[0].alias("startDate"), w[1].alias("endDate"), "p.startDtm", "p.endDtm", "p.battStart", "p.battEnd",
        "p.battDiff")


def alarm_days(t: FleetTables, start, end) -> DataFrame:
    days = error_rows(t.errors, start, end, ALARM_CODES).groupBy("fridgeid").agg(
        F.count_distinct(F.to_date("measureddtm")).alias("days"))
    return tech_rows(days, "High", "High Temp Alarm", "Number of Alarm Days", F.col("days"))


def sd_card_errors(t: FleetTables, start, end, limits: Limits = Limits()) -> DataFrame:
    """Sum of the distinct counts of each message, one record per device and second."""
    message = F.col("e.message")
    one_per_second = error_rows(t.errors, start, end, SD_CARD_CODES).groupBy("fridgeid", "measureddtm").agg(
        F.min(F.struct("id", "message")).alias("e"))
    counted = has_parenthesis(message)
    parsed = one_per_second.select(
        "fridgeid", F.when(~counted, message).otherwise(before_space(message)).alias("msg"),
        F.when(~counted, F.lit(1)).otherwise(to_count(inside_parentheses(message))).alias("ct"))
    totals = parsed.groupBy("fridgeid", "msg").agg(F.sum_distinct("ct").alias("total"))
    return tech_rows(totals.where(F.col("total") > limits.sd_card_min), "Low", "SD Card Error",
                     F.concat(F.col("msg"), F.lit(" Error Count")), F.col("total"), F.col("total"))


def long_door_open(t: FleetTables, start, end, limits: Limits = Limits(), codes: Iterable[str] | None = DOOR_CODES,
                   interval: str = "Hour") -> DataFrame:
    islands = bucket_islands(error_rows(t.errors, start, end, codes), interval)
    longest = islands.groupBy("fridgeid").agg(F.max("length").alias("longest"))
    return tech_rows(longest.where(F.col("longest") > limits.door_hours), "High", "Door Open Alert", "Open Hours", F.col("longest"))


def _trips(edges: DataFrame, min_count: int, limits: Limits) -> DataFrame:
    hits = edges.where((F.col("avg_w") < limits.trip_max_w) & (F.col("samples") > min_count))
    return hits.groupBy("fridgeid").agg(F.count(F.lit(1)).alias("events"))


def _trip_count(edges: DataFrame, min_count: int, limits: Limits) -> DataFrame:
    return _trip_rows(_trips(edges, min_count, limits))


def _trip_rows(counted: DataFrame) -> DataFrame:
    return tech_rows(counted, "Medium", "Mech Thermostat Engaged", "Event Count", F.col("events"), only="M")


def mech_trips(t: FleetTables, start, end, limits: Limits = Limits()) -> DataFrame:
    near, span = limits.tech_trip_near_s, limits.tech_trip_span_s
    edges = edge_power(t.sensor, start, end, [tech_stop_frame(near, span), tech_start_frame(near, span)])
    return _trip_count(edges, limits.tech_trip_min_count, limits)


def mech_trips_slow_start(t: FleetTables, start, end, limits: Limits = Limits()) -> DataFrame:
    edges = edge_power(t.sensor, start, end, [tech_start_frame(limits.slow_trip_near_s, limits.slow_trip_span_s)])
    return _trip_count(edges, limits.slow_trip_min_count, limits)


def slow_stops(t: FleetTables, start, end, limits: Limits = Limits()) -> DataFrame:
    """(fridgeid, events): stops of the older variant, counted."""
    edges = edge_power(t.sensor, start, end, [tech_stop_frame(limits.slow_trip_near_s, limits.slow_trip_span_s)])
    return _trips(edges, limits.slow_trip_min_count, limits)


def mech_trips_slow_stop(t: FleetTables, start, end, limits: Limits = Limits(), literal: bool = True) -> DataFrame:
    """Older stop-only variant. Literally it adds a count of starts that is never set, so the sum is null and nothing is found."""
    starts = F.lit(None).cast("bigint") if literal else F.lit(0)
    found = slow_stops(t, start, end, limits).withColumn("events", F.col("events") + starts).where("events > 0")
    return _trip_rows(found)


def mech_trip_times(t: FleetTables, start, end, limits: Limits = Limits()) -> DataFrame:
    """Event list of both edge directions, without roll-up or class gate."""
    edges = edge_power(t.sensor, start, end, trip_frames(limits))
    return edges.where(F.col("avg_w") < limits.trip_max_w).select("fridgeid", F.col("EventTime").alias("dtm"))
