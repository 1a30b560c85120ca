"""One row of counters per device and window, from one scan of each source.

Counters are combined map-side over short slots, then hours, then days, then
devices, so that distinct slots, hours and days are plain counts and no device is
ever gathered in one task. Only the levels and counters a caller asks for are
planned; the scan reads only the columns they need.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import Limits
from ..sources.tables import FleetTables, between

SENSOR, SOLAR, PV = "sensor", "solar_sensor", "pv"
LEVELS = (("slot", 600), ("hour", 3600), ("day", 86400))
# Seconds and the whole id side by side; the factor exceeds the span of a long, so no id reaches into the seconds.
ORDER_IDS = 10 ** 20
ORDER_KEY = f"(cast(unix_seconds(measureddtm) as decimal(14,0)) * {ORDER_IDS}BD + cast(reading_id as decimal(20,0)))"


@dataclass(frozen=True)
class Counter:
    """An aggregate over readings, and the function that combines it over levels."""

    source: str
    sql: str
    merge: str = "sum"


@dataclass(frozen=True)
class Derived:
    """Counts the groups of a level that satisfy a condition on another counter."""

    level: str
    needs: str | None = None
    condition: str = "true"


def _power_ok(volt_min: float, limits: Limits, pv: bool = False) -> str:
    ok = f"SLNX = 1 or (SLNX is null and EVLN > {volt_min} and EVLN < {limits.volt_max})"
    return f"{ok} or EWDCA > {limits.pv_ok_w}" if pv else ok


def counters(limits: Limits) -> dict[str, Counter]:
    volt_ok = f"EVLN > {limits.volt_min} and EVLN < {limits.volt_max}"
    running = f"EWCP2 > {limits.leak_min_w} and SCPX = 1"
    cold = f"TVCTOPCTL < {limits.low_temp_c}"
    counted = {
        "volt_ok": (SENSOR, volt_ok),
        "hz_bad": (SENSOR, f"{volt_ok} and (EHZLN < {limits.hz_min} or EHZLN > {limits.hz_max})"),
        "mains_ok": (SENSOR, _power_ok(limits.legacy_volt_min, limits)),
        "low_top": (SENSOR, cold), "low_any": (SENSOR, f"{cold} or TVCBOT < {limits.low_temp_c}"),
        "leak_low": (SENSOR, f"{running} and EWCP2 < {limits.leak_max_w}"), "leak_all": (SENSOR, running),
        "state_6": (SENSOR, "SCPX = 6"), "state_2": (SENSOR, "SCPX = 2"), "slnx_on": (SOLAR, "SLNX = 1"),
        "solar_ok": (SOLAR, _power_ok(limits.legacy_volt_min, limits, pv=True)),
        "supply_ok": (SOLAR, _power_ok(limits.volt_min, limits, pv=True)),
        "pv_on": (PV, f"EWDCA > {limits.zero_pv_w}"),
    }
    present = ("SCPX", "EVLN", "TAMDAQ", "TVCTOPCTL", "TICMCTL", "TICBKCTL", "CTBH", "TVCBOT")
    return {
        "n": Counter(SENSOR, "count(1)"),
        **{f"{name.lower()}_n": Counter(SENSOR, f"count({name})") for name in present},
        **{name: Counter(source, f"count_if({condition})") for name, (source, condition) in counted.items()},
        "top_sum": Counter(SENSOR, "sum(TVCTOPCTL)"), "bottom_sum": Counter(SENSOR, "sum(TVCBOT)"),
        "ctbh_sum": Counter(SENSOR, "sum(CTBH)"),
        "battery_max": Counter(SENSOR, "max(EVDBAT)", "max"), "pv_max": Counter(PV, "max(EWDCA)", "max"),
        "last_time": Counter(SENSOR, "max(measureddtm)", "max"),
        # the newest reading counts even where its holdover is missing
        "last_key": Counter(SENSOR, f"max({ORDER_KEY})", "max"),
        "ctbh_last": Counter(SENSOR, f"max_by(CTBH, {ORDER_KEY})", "latest"),
    }


def derived(limits: Limits) -> dict[str, Derived]:
    return {
        "slots": Derived("slot"),
        "battery_hours": Derived("hour", "battery_max", f"battery_max < {limits.battery_volt}"),
        "low_days": Derived("day", "low_top", "low_top > 0"),
        "low_any_days": Derived("day", "low_any", "low_any > 0"),
        "duplicate_days": Derived("day", "n", f"n > {limits.duplicate_per_day}"),
    }


def _merged(name: str, how: str):
    return F.expr(f"max_by({name}, last_key) as {name}" if how == "latest" else f"{how}({name}) as {name}")


def _source_profile(frame: DataFrame, start, end, base: dict[str, Counter], over: dict[str, Derived]) -> DataFrame:
    rows = between(frame, start, end)
    asked = {d.level for d in over.values()}
    levels = [level for level in LEVELS if level[0] in asked]
    merges = {name: c.merge for name, c in base.items()}
    first = [F.expr(f"{c.sql} as {name}") for name, c in base.items()]
    if not levels:
        return rows.groupBy("fridgeid").agg(*first)
    period = F.expr(f"floor(unix_seconds(measureddtm) / {levels[0][1]}) as period")
    grouped = rows.groupBy("fridgeid", period).agg(*first) if first else rows.select("fridgeid", period).distinct()
    for i, (level, seconds) in enumerate(levels):
        hits = {name: d for name, d in over.items() if d.level == level}
        keys = ["fridgeid"]
        if i + 1 < len(levels):
            keys.append(F.expr(f"floor(period * {seconds} / {levels[i + 1][1]}) as period"))
        grouped = grouped.groupBy(*keys).agg(
            *[_merged(name, how) for name, how in merges.items()],
            *[F.expr(f"count_if({d.condition}) as {name}") for name, d in hits.items()])
        merges.update({name: "sum" for name in hits})
    return grouped


def device_profile(t: FleetTables, start, end, want: Iterable[str], limits: Limits = Limits()) -> DataFrame:
    """The asked counters of every device that has rows in the window."""
    want = set(want)
    if "ctbh_last" in want:
        want.add("last_key")
    known, over = counters(limits), derived(limits)
    unknown = want - known.keys() - over.keys()
    if unknown:
        raise ValueError(f"unknown counters: {sorted(unknown)}")
    over = {name: d for name, d in over.items() if name in want}
    needed = want | {d.needs for d in over.values() if d.needs}
    frames: list[tuple[DataFrame, dict[str, Counter], dict[str, Derived]]] = []
    for source in (SENSOR, SOLAR, PV):
        mine = {name: c for name, c in known.items() if c.source == source and name in needed}
        levels = over if source == SENSOR else {}
        if not mine and not levels:
            continue
        frame = getattr(t, source)
        # views over one physical table share a single scan
        shared = next((f for f in frames if f[0] is frame), None)
        if shared:
            shared[1].update(mine)
        else:
            frames.append((frame, mine, levels))
    joined = None
    for frame, mine, levels in frames:
        part = _source_profile(frame, start, end, mine, levels)
        joined = part if joined is None else joined.join(part, "fridgeid", "full")
    return joined.select("fridgeid", *sorted(want))


# Sums in the reports, NULL where a device has no rows; all other counters are then 0.
NULL_WITHOUT_ROWS = {
    "mains_ok", "solar_ok", "supply_ok", "slnx_on", "pv_on", "tamdaq_n", "tvctopctl_n", "ticmctl_n", "ticbkctl_n",
    "ctbh_n", "top_sum", "bottom_sum", "ctbh_sum", "battery_max", "pv_max", "last_time", "last_key", "ctbh_last",
}


def fleet_profile(devices: DataFrame, t: FleetTables, start, end, want: Iterable[str],
                  limits: Limits = Limits()) -> DataFrame:
    """Profile of every listed device, also of those without any reading."""
    want = set(want)
    zero = sorted(c for c in want if c not in NULL_WITHOUT_ROWS)
    return devices.join(device_profile(t, start, end, want, limits), "fridgeid", "left").fillna(0, subset=zero)
