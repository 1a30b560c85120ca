"""Technician detectors: SQL of each finding over all devices."""

from __future__ import annotations

from .base import TABLES, query, slot, text, window, window_days, window_minutes
from .eng import edge_ctes, settled
from .settings import END, START
from .values import L

DEVICES = "device"


def row(priority: str | None, message: str, detail: str | None, value: str, errors: str, source: str) -> str:
    """``detail`` is text, or SQL when it starts with ``=``."""
    if detail is None:
        shown = "null"
    else:
        shown = detail[1:] if detail.startswith("=") else text(detail)
    return (f"select fridgeid, cast({'null' if priority is None else text(priority)} as varchar) as Priority, {text(message)} as Message, "
            f"cast({shown} as varchar) as Detail, cast({value} as double) as value, cast({errors} as int) as errCnt from {source}")


def _scalar(expr: str, start: str, end: str, also: str = "", alias: str = "s") -> str:
    return f"(select {expr} from sensor s where s.fridgeid = d.fridgeid and {window('s.measureddtm', start, end)}{also})"


def _aggregates(columns: dict[str, str], start: str, end: str) -> str:
    """Per listed device, as an aggregate without GROUP BY: one row even where nothing was measured."""
    listed = ", ".join(f"{expr} as {name}" for name, expr in columns.items())
    return (f"(select d.fridgeid, a.* from {DEVICES} d, lateral (select {listed} from sensor s "
            f"where s.fridgeid = d.fridgeid and {window('s.measureddtm', start, end)}) a)")


def _r1(expr: str) -> str:
    return f"round({expr}, 1)"


def _pct(part: str, whole: str) -> str:
    return f"case when {whole} = 0 then 0 else {part}::double / {whole}::double * 100.0 end"


def data_rx(start, end) -> str:
    minutes = window_minutes(start, end)
    return (f"(select d.fridgeid, count(distinct {slot('s.measureddtm', 600)})::double / ({minutes} / 10.0::double) * 100.0 as pct "
            f"from {DEVICES} d left join sensor s on s.fridgeid = d.fridgeid and {window('s.measureddtm', start, end)} group by d.fridgeid)")


def missing_data(start=START, end=END):
    return row("Low", "Missing Data", "Data Rx %", _r1("pct"), "null", f"{data_rx(start, end)} where {_r1('pct')} < {L.data_rx_pct}")


def _presence(start, end) -> str:
    return _aggregates({
        "n": "count(s.measureddtm)", "scpx": "count(s.SCPX)",
        **{c: f"sum(case when s.{c} is null then 0 else 1 end)" for c in ("TAMDAQ", "TVCTOPCTL", "TICMCTL", "TICBKCTL", "CTBH")}},
        start, end)


def sensor_presence(start=START, end=END, only: str | None = None):
    source = _presence(start, end)

    def pct(c, base):
        return f"(case when {base} = 0 then 0 else round({c}::double / {base}::double * 100.0, 1) end)"

    enough = f"scpx > {L.control_min_rows}"
    both = f"(case when {pct('TICMCTL', 'scpx')} > {pct('TICBKCTL', 'scpx')} then {pct('TICMCTL', 'scpx')} else {pct('TICBKCTL', 'scpx')} end)"
    limit = L.present_pct
    parts = {
        "usb_board": row("Medium", "USB Board - Control Sensor Error", "TAMDAQ OK %", pct("TAMDAQ", "n"), "n - TAMDAQ",
                         f"{source} where {pct('TAMDAQ', 'n')} < {limit}"),
        "control_sensor": row("Low", "Control Sensor Error", "TVCTOPCTL OK %", pct("TVCTOPCTL", "scpx"), "n - TVCTOPCTL",
                              f"{source} where {pct('TVCTOPCTL', 'scpx')} < {limit} and {enough}"),
        "ice_sensor": row("Low", "Ice Sensor Error", "TICMCTL OK %", pct("TICMCTL", "scpx"), "n - TICMCTL",
                          f"{source} where {pct('TICMCTL', 'scpx')} < {limit} and {enough}"),
        "ice_backup_sensor": row("Low", "Ice Sensor Error", "TICBKCTL OK %", pct("TICBKCTL", "scpx"), "n - TICBKCTL",
                                 f"{source} where {pct('TICBKCTL', 'scpx')} < {limit} and {enough}"),
        "no_holdover": row("Low", "No Calculated Holdover", "Check Sensor Errors", pct("CTBH", "n"), "null",
                           f"{source} where {pct('CTBH', 'n')} < {L.holdover_pct}"),
        "both_ice_sensors": row("Medium", "Both Ice Sensors Missing Error", "Control OK %", both, "null",
                                f"{source} where {pct('TICMCTL', 'scpx')} < {L.both_ice_pct} and {pct('TICBKCTL', 'scpx')} < {L.both_ice_pct} and {enough}"),
    }
    return parts[only] if only else " union all ".join(parts.values())


def _power(volt_min: float, pv: bool) -> str:
    also = f" or s.EWDCA > {L.pv_ok_w}" if pv else ""
    return (f"sum(case when s.SLNX = 1 or (s.SLNX is null and s.EVLN > {volt_min} and s.EVLN < {L.volt_max}){also} then 1 else 0 end)")


def _availability(message: str, pv: bool, limit: float, start, end):
    expected = window_minutes(start, end) * L.samples_per_day / 1440.0
    source = _aggregates({"ok": _power(L.legacy_volt_min, pv)}, start, end)
    pct = _r1(f"ok::double / {expected}::double * 100.0")
    return row("Medium", message, "Power OK %", pct, "null", f"{source} where {pct} < {limit}")


def low_mains_power(start=START, end=END):
    return _availability("Low Mains Power Availability", False, L.mains_ok_pct, start, end)


def low_solar_power(start=START, end=END):
    return _availability("Low Solar Power Availability", True, L.solar_ok_pct, start, end)


def dirty_panels(start=START, end=END):
    source = _aggregates({"pv": "round(max(s.EWDCA), 0)"}, start, end)
    return row("Low", "Low Solar Power", "Max EWDCA", "pv", "null", f"{source} where pv < {L.dirty_panel_w}")


def no_solar_power(start=START, end=END):
    pv = _aggregates({"lit": f"sum(case when s.EWDCA > {L.zero_pv_w} then 1 else 0 end)"}, start, end)
    return row("Medium", "Solar Power Disconnected", "Data Rx %", "round(pct, 0)", "null",
               f"{data_rx(start, end)} join {pv} using (fridgeid) where lit = 0 and pct > {L.zero_pv_rx_pct}")


def battery_missing(start=START, end=END):
    hours = (f"(select fridgeid, count(*) as ct from (select fridgeid, max(EVDBAT) as v from sensor where {window('measureddtm', start, end)} "
             f"group by fridgeid, year(measureddtm), month(measureddtm), day(measureddtm), hour(measureddtm)) where v < {L.battery_volt} group by fridgeid)")
    return row("Medium", "Battery Missing Error", "1-hour Max Batt < .2 v", "null", "ct", f"{hours} where ct > 0")


def line_frequency(start=START, end=END):
    volt = f"s.EVLN > {L.volt_min} and s.EVLN < {L.volt_max}"
    scalars = (
        f"(select d.fridgeid, "
        f"{_scalar('count(*)', start, end, f' and (s.EHZLN < {L.hz_min} or s.EHZLN > {L.hz_max}) and {volt}')} as hz_bad, "
        f"{_scalar('count(*)', start, end, f' and {volt}')} as v_ok, {_scalar('count(*)', start, end, ' and s.EVLN is not null')} as v_all, "
        f"{_scalar('sum(case when s.SLNX = 1 then 1 else 0 end)', start, end)} as slnx from {DEVICES} d)")
    expected = L.samples_per_day * window_days(start, end)
    pct = (f"(select *, case when v_ok = 0 then 0 else 100.0 - (hz_bad::double / v_ok::double) * 100.0 end as hz_pct, "
           f"case when v_all = 0 then 0 else 100 - (v_ok::double / v_all::double) * 100.0 end as v_pct, "
           f"case when slnx = 0 then 0 else slnx / {expected}::double * 100.0 end as slnx_pct from {scalars})")
    return row("Medium", "Line Frequency Abnormal", "In Range %", _r1("hz_pct"), "trunc(v_pct)",
               f"{pct} where v_ok > 1 and hz_pct < {L.hz_ok_pct} and v_pct > {L.hz_volt_out_pct} and slnx_pct < {L.hz_power_ok_pct}")


def refrigerant_leak(start=START, end=END):
    on = f" and s.EWCP2 > {L.leak_min_w} and s.SCPX = 1"
    scalars = (f"(select d.fridgeid, {_scalar('count(*)', start, end, on + f' and s.EWCP2 < {L.leak_max_w}')} as v1, "
               f"{_scalar('count(*)', start, end, on)} as v2 from {DEVICES} d)")
    pct = f"(select *, 100.0 - ({_pct('v1', 'v2')}) as pct from {scalars})"
    return row("High", "Possible refrigerant leak", "Compressor Power %", _r1("pct"), "null", f"{pct} where pct < {L.leak_pct}")


def solar_low_ice(start=START, end=END):
    counts = (f"(select d.fridgeid, {_scalar('count(*)', start, end, ' and s.SCPX = 6')} as c6, "
              f"{_scalar('count(*)', start, end, ' and s.SCPX = 2')} as c2 from {DEVICES} d)")
    a = row("Low", "Solar Fridge Low Ice", "Undersatisfied", "null", "null", f"{counts} where c6 > 1 and c2 = 0")
    b = row("Medium", "Solar Fridge Low Ice", "Not Enough Ice", "null", "null", f"{counts} where c6 = 0 and c2 = 0")
    return f"{a} union all {b}"


def low_temperature(start=START, end=END, bottom: bool = False):
    cold = f"TVCTOPCTL < {L.low_temp_c}" + (f" or TVCBOT < {L.low_temp_c}" if bottom else "")
    minutes = (f"(select fridgeid, date_trunc('minute', measureddtm) as m, sum(case when {cold} then 1 else 0 end) as c "
               f"from sensor where {window('measureddtm', start, end)} group by all)")
    days = (f"(select fridgeid, count(*) as days from (select distinct fridgeid, date_trunc('day', m) as dd from {minutes} where c > 0) "
            f"group by fridgeid)")
    return row("High", "Low Temperature Alert", "Days (Count)", "days", "null", f"{days} where days > 0")


def _missing(column: str, priority: str, message: str, start, end):
    source = _aggregates({"n": "count(s.measureddtm)", "c": f"count(s.{column})"}, start, end)
    pct = f"(case when n = 0 then 0 else c::double / n::double * 100.0 end)"
    return row(priority, message, "Data OK %", _r1(pct), "null", f"{source} where {pct} < {L.present_pct}")


def missing_power_board(start=START, end=END):
    return _missing("EVLN", "Medium", "Missing Power Board Data", start, end)


def missing_control_board(start=START, end=END):
    return _missing("SCPX", "Low", "Missing Control Board Data", start, end)


def missing_usb_board(start=START, end=END):
    return _missing("TAMDAQ", "Medium", "Missing USB Board Data", start, end)


def missing_holdover(start=START, end=END):
    return _missing("CTBH", "Low", "Missing CTBH", start, end)


def duplicate_device(start=START, end=END):
    days = (f"(select fridgeid, count(*) as days from (select fridgeid, cast(measureddtm as date) as dd, count(*) as ct from sensor "
            f"where {window('measureddtm', start, end)} group by all) where ct > {L.duplicate_per_day} group by fridgeid)")
    return row(None, "Data Error", "Duplicate FridgeId", "null", "days", days)


def _pairs(start, end) -> str:
    later = ("(select s.event_id from sensor s where s.fridgeid = v.fridgeid and s.measureddtm >= v.measureddtm + interval "
             f"{L.drain_after_s} second and s.measureddtm < timestamp '{end}' order by s.measureddtm, s.event_id limit 1)")
    return (f"(select v.fridgeid, v.measureddtm as dtm1, n.measureddtm as dtm2, v.ECDBAT as b1, n.ECDBAT as b2 "
            f"from (select *, {later} as next_id from sensor v where {window('measureddtm', start, end)}) v "
            f"join sensor n on n.event_id = v.next_id where v.ECDBAT is not null and n.ECDBAT is not null "
            f"and datediff('minute', v.measureddtm, n.measureddtm) < {L.drain_minutes})")


def battery_drain(start=START, end=END):
    worst = f"(select fridgeid, min(b2 - b1) as worst from {_pairs(start, end)} group by fridgeid)"
    return row("Low", "Fast Battery Drain", None, "null", "null", f"{worst} where worst < {L.drain_limit}")


def first_battery_pair(start=START, end=END):
    return (f"select fridgeid, date '{start}' as startDate, date '{end}' as endDate, dtm1 as startDtm, dtm2 as endDtm, b1 as battStart, "
            f"b2 as battEnd, b2 - b1 as battDiff from (select *, row_number() over (partition by fridgeid order by dtm2, dtm1, b1) as r "
            f"from {_pairs(start, end)}) where r = 1")


def alarm_days(start=START, end=END):
    days = (f"(select fridgeid, count(*) as days from (select distinct fridgeid, cast(measureddtm as date) as dd from errors "
            f"where id in ('4406', '6402') and {window('measureddtm', start, end)}) group by fridgeid)")
    return row("High", "High Temp Alarm", "Number of Alarm Days", "days", "null", f"{days} where days > 0")


def sd_card_errors(start=START, end=END):
    first = (f"(select fridgeid, case when position('(' in message) = 0 then message when position(' ' in message) = 0 then '' "
             f"else substring(message, 1, position(' ' in message) - 1) end as msg, "
             f"case when position('(' in message) = 0 then 1 else cast(regexp_extract(message, '[(]([^)]*)[)]', 1) as int) end as ct "
             f"from (select *, row_number() over (partition by fridgeid, measureddtm order by id, message) as rn from errors "
             f"where id in ('6782', '6784', '6301', '630D') and {window('measureddtm', start, end)}) where rn = 1)")
    sums = f"(select fridgeid, msg, sum(ct) as total from (select fridgeid, msg, ct from {first} group by all) group by fridgeid, msg)"
    return row("Low", "SD Card Error", "=msg || ' Error Count'", "total", "total", f"{sums} where total > {L.sd_card_min}")


def long_door_open(start=START, end=END, codes: str | None = None, interval: str = "day", limit: float = L.door_hours):
    only = f" and id = '{codes}'" if codes else ""
    a = f"(select distinct fridgeid, date_trunc('{interval}', measureddtm) as b from errors where {window('measureddtm', start, end)}{only})"
    gaps = (f"(select *, datediff('{interval}', b, lead(b) over (partition by fridgeid order by b)) as gap from {a})")
    flags = f"(select *, case when gap is null then 0 when gap = 1 then 0 else 1 end as g from {gaps})"
    groups = f"(select *, sum(g) over (partition by fridgeid order by b) as island from {flags})"
    longest = f"(select fridgeid, max(ct) as longest from (select fridgeid, island, count(*) as ct from {groups} group by all) group by fridgeid)"
    return row("High", "Door Open Alert", "Open Hours", "longest", "null", f"{longest} where longest > {limit}")


def trip_edges(start=START, end=END, near: int | None = None, span: int | None = None) -> str:
    near, span = near or L.tech_trip_near_s, span or L.tech_trip_span_s
    return (edge_ctes("t_stop", "stop", "after", *settled(near, span, "stop"), start, end) + ", "
            + edge_ctes("t_start", "start", "after", *settled(near, span, "start"), start, end))


def mech_trips(sources=("t_stop", "t_start"), min_count: int | None = None):
    least = L.tech_trip_min_count if min_count is None else min_count
    union = " union all ".join(f"select fridgeid from {s} where watts < {L.trip_max_w} and ct > {least}" for s in sources)
    counts = f"(select fridgeid, count(*) as events from ({union}) group by fridgeid)"
    return row("Medium", "Mech Thermostat Engaged", "Event Count", "events", "null", f"{counts} where events > 0")


def last_run(start=START, end=END) -> str:
    """CTEs ending in ``last_run(fridgeid, lastDte, runDurSec, runAgeMin)``."""
    w = window("measureddtm", start, end)
    return f"""
filled as (select fridgeid, measureddtm, event_id,
    coalesce(EWCP2, lead(EWCP2) over (partition by fridgeid order by measureddtm, event_id)) as w from sensor where {w}),
pulses as (select fridgeid, measureddtm,
    case when coalesce(w, 0) > {L.run_w} and lag(coalesce(w, 0)) over o <= {L.run_w} then 1 else 0 end as st,
    case when coalesce(w, 0) > {L.run_w} and lead(coalesce(w, 0)) over o <= {L.run_w} then 1 else 0 end as sp
    from filled window o as (partition by fridgeid order by measureddtm, event_id)),
last_rows as (select fridgeid, measureddtm, EWCP2, row_number() over (partition by fridgeid order by measureddtm desc, event_id desc) as r
    from sensor where measureddtm > timestamp '{start}' and measureddtm < timestamp '{end}'),
changes as (select fridgeid, measureddtm, st, sp from pulses where st != sp union all
    select fridgeid, measureddtm, 0, 1 from last_rows where r = 1 and EWCP2 > {L.run_w}),
runs as (select *, datediff('second', lag(measureddtm) over (partition by fridgeid order by measureddtm, sp), measureddtm) as sec from changes),
last_run as (select fridgeid, measureddtm as lastDte, cast(sec as int) as runDurSec,
    cast(datediff('minute', measureddtm, timestamp '{end}') as int) as runAgeMin
    from (select *, row_number() over (partition by fridgeid order by measureddtm desc) as r from runs where sp = 1 and sec > {L.run_min_s}) where r = 1)"""


def statement(select: str, ctes: str = "") -> str:
    return query(f"{ctes}\n{select}") if ctes else f"{TABLES}\n{select}"
