"""Engineering detectors: SQL of each as ``(ctes, select)``."""

from __future__ import annotations

from . import values as names
from .base import (SOLAR, bucket, code, device_link, error_link, finding, number, query, rolled, slot, text, week, window)
from .settings import END, START, WEEK_END, WEEK_START
from .values import L

HOUR, DAY = "EventTime + interval 1 hour", "EventTime + interval 1 day"


def _events(name: str, columns: str, condition: str, start: str, end: str) -> str:
    return (f"{name} as (select fridgeid, measureddtm as EventTime, event_id, {columns} from sensor "
            f"where {window('measureddtm', start, end)} and {condition})")


def bad_time(interval, start=START, end=END):
    cte = (f"bad as (select fridgeid, createddtm as EventTime, count(*) as ct from bad_time_errors "
           f"where {window('createddtm', start, end)} group by all)")
    m, d = map(text, names.BAD_TIME)
    if interval == "All":
        return cte, finding("All", m, d, "null", "ct", "EventTime", device_link("EventTime", "EventTime", 1200), "bad")
    return cte, finding(interval, m, d, "null", "n", "EventTime", device_link("first_time", "last_time", 1200),
                        f"{rolled('bad', interval)} where n > {L.bad_time_min}")


def failed_starts(interval, start=START, end=END):
    cte = (f"failed as (select fridgeid, measureddtm as EventTime from errors "
           f"where id = 'E0A1' and {window('measureddtm', start, end)})")
    m, d = map(text, names.FAILED_START)
    codes = code("'E0A1'")
    if interval == "All":
        return cte, finding("All", m, d, "null", "1", "EventTime", error_link("EventTime", DAY, 1200, codes), "failed")
    return cte, finding(interval, m, d, "null", "n", "EventTime", error_link("first_time", "last_time", 1200, codes),
                        rolled("failed", interval))


def high_voltage(interval, start=START, end=END):
    cte = _events("volts", "EVLN as value", f"EVLN > {L.high_volt}", start, end)
    m = text(names.VOLTAGE)
    if interval == "All":
        return cte, finding("All", m, text(names.VOLTAGE_EVENT), number("value"), "1", "EventTime",
                            device_link("EventTime", HOUR, 600), "volts")
    return cte, finding("Day", m, text(names.VOLTAGE_DAY), number("value"), "n", "EventTime",
                        device_link("first_time", "last_time", 600), rolled("volts", "Day", "value desc, EventTime"))


def low_temperature(interval, start=START, end=END):
    part = "select fridgeid, measureddtm as EventTime, {d} as Detail, {c} as value from sensor where {w} and {c} < {t}"
    top = part.format(d=text(names.LOW_TOP), c="TVCTOPCTL", w=window("measureddtm", start, end), t=L.low_temp_c)
    bottom = part.format(d=text(names.LOW_BOTTOM), c="TVCBOT", w=window("measureddtm", start, end), t=L.low_temp_c)
    cte = f"lows as ({top} union all {bottom})"
    m = text(names.LOW_TEMP)
    if interval == "All":
        return cte, finding("All", m, "Detail", number("value"), "1", "EventTime", device_link("EventTime", HOUR, 1200), "lows")
    return cte, finding("Day", m, "Detail", number("value"), "n", "EventTime", device_link("first_time", "last_time", 1200),
                        rolled("lows", "Day", "value, EventTime, Detail"))


def ambient(interval, start=START, end=END):
    cold = _events("cold", "TAMDAQ as value", f"TAMDAQ < {L.ambient_low_c}", start, end)
    hot = _events("hot", "TAMDAQ as value", f"TAMDAQ > {L.ambient_high_c}", start, end)
    parts = []
    for source, (m, d), worst in (("cold", names.AMBIENT_LOW, "value"), ("hot", names.AMBIENT_HIGH, "value desc")):
        if interval == "All":
            parts.append(finding("All", text(m), text(d), number("value"), "1", "EventTime",
                                 device_link("EventTime", "EventTime", 1200), source))
        else:
            parts.append(finding("Week", text(m), text(d), number("value"), "n", "EventTime",
                                 device_link("first_time", "last_time", 1200), rolled(source, "Week", f"{worst}, EventTime")))
    return f"{cold}, {hot}", " union all ".join(parts)


def _by_value(raw: str) -> str:
    numbered = (f"(select *, row_number() over (partition by fridgeid, b order by value desc, EventTime) as r_high, "
                f"row_number() over (partition by fridgeid, b order by value, EventTime) as r_low "
                f"from (select *, {bucket('Day')} as b from {raw}))")
    return (f"(select h.*, l.EventTime as low_time, c.n from (select * from {numbered} where r_high = 1) h "
            f"join (select fridgeid, b, EventTime from {numbered} where r_low = 1) l using (fridgeid, b) "
            f"join (select fridgeid, b, count(*) as n from {numbered} group by all) c using (fridgeid, b))")


def high_power(interval, start=START, end=END):
    solar = _events("sunny", "EWCP as value", f"EWCP > {L.solar_power_w} and fridgeid in {SOLAR}", start, end)
    mains = _events("mains", "EWCP2 as value", f"EWCP2 > {L.mains_power_w} and fridgeid not in {SOLAR}", start, end)
    between = f"value > {L.mains_power_w} and value < {L.mains_power_high_w}"
    above = f"value > {L.mains_power_high_w}"
    ms, ds, mm = text(names.SOLAR_POWER[0]), text(names.SOLAR_POWER[1]), text(names.MAINS_POWER)
    if interval == "All":
        detail = (f"case when {between} then {text(names.MAINS_EVENT_600)} when {above} then {text(names.MAINS_EVENT_1000)} end")
        link = device_link("EventTime", HOUR, 7200)
        a = finding("All", ms, ds, number("value"), "1", "EventTime", link, "sunny")
        b = finding("All", mm, detail, number("value"), "1", "EventTime", link, "mains")
        return f"{solar}, {mains}", f"{a} union all {b}"
    counts = (f"mains_days as (select fridgeid, {bucket('Day')} as b, sum(case when {between} then 1 else 0 end) as c600, "
              f"sum(case when {above} then 1 else 0 end) as c1000 from mains group by all)")
    link = device_link("low_time", "EventTime", 7200)
    a = finding("Day", ms, ds, number("value"), "n", "EventTime", link, _by_value("sunny"))
    b = finding("Day", mm,
                f"case when c600 >= 2 then {text(names.MAINS_DAY_600)} when c1000 >= 1 then {text(names.MAINS_DAY_1000)} end",
                number("value"), "case when c600 >= 2 then c600 when c1000 >= 1 then c1000 end", "EventTime", link,
                f"{_by_value('mains')} join mains_days using (fridgeid, b) where c600 >= 2 or c1000 >= 1")
    return f"{solar}, {mains}, {counts}", f"{a} union all {b}"


def overlapping(interval, start=START, end=END):
    cte = (f"hourly as (select fridgeid, date_trunc('hour', measureddtm) as EventTime, count(measureddtm) as ct from sensor "
           f"where {window('measureddtm', start, end)} group by all)")
    m, d = map(text, names.OVERLAP)
    link = device_link("EventTime", "EventTime", 12000)
    if interval == "All":
        return cte, finding("All", m, "null", "null", "ct", "EventTime", link, "hourly")
    return cte, finding("Hour", m, d, "null", "ct", "EventTime", link, f"hourly where ct >= {L.overlap_per_hour}")


def no_door(start=WEEK_START, end=WEEK_END):
    m, d = map(text, names.NO_DOOR)
    last = (f"(select max(s.measureddtm) from sensor s where s.fridgeid = x.fridgeid and s.measureddtm < timestamp '{start}' "
            f"and s.measureddtm >= timestamp '{start}' - interval {L.door_lookback_days} day and s.SDXC > 0)")
    cte = (f"doors as (select *, {last} as last_open from (select fridgeid, sum(SDXC) as ct from sensor "
           f"where {window('measureddtm', start, end)} group by fridgeid) x where ct = 0)")
    return cte, finding("Week", m, d, "null", "ct", "last_open",
                        device_link(f"timestamp '{start}'", f"timestamp '{end}'", 1200), "doors")


# --- edges -----------------------------------------------------------------------------------


def edge_ctes(name: str, change: str, anchor: str, lo: str, hi: str, start=START, end=END) -> str:
    """Theta join of state changes with running readings; ``lo``/``hi`` compare s.measureddtm with e.edge_time."""
    flip = {"stop": "s1 = 1 and s2 != 1", "start": "s1 != 1 and s2 = 1"}[change]
    at = {"before": "t1", "after": "t2"}[anchor]
    return (
        f"{name}_states as (select fridgeid, measureddtm as t1, SCPX as s1, "
        f"lead(measureddtm) over w as t2, lead(SCPX) over w as s2 from sensor where {window('measureddtm', start, end)} "
        f"window w as (partition by fridgeid order by measureddtm, event_id)), "
        f"{name} as (select e.fridgeid, e.edge_time, count(*) as ct, avg(s.EWCP2) as watts, avg(s.TAMDAQ) as ambient "
        f"from (select fridgeid, {at} as edge_time from {name}_states where {flip}) e join sensor s on s.fridgeid = e.fridgeid "
        f"and {lo} and {hi} and s.SCPX = 1 and s.EWCP2 != 0 group by e.fridgeid, e.edge_time)")


def around(near: int, far: int, change: str) -> tuple[str, str]:
    """Inclusive frame before a stop or after a start."""
    if change == "stop":
        return (f"s.measureddtm >= e.edge_time - interval {far} second", f"s.measureddtm <= e.edge_time - interval {near} second")
    return (f"s.measureddtm >= e.edge_time + interval {near} second", f"s.measureddtm <= e.edge_time + interval {far} second")


def settled(near: int, span: int, change: str) -> tuple[str, str]:
    """Exclusive frame of ``span`` seconds, ``near`` seconds from the edge."""
    if change == "stop":
        return (f"s.measureddtm > e.edge_time - interval {near + span} second", f"s.measureddtm < e.edge_time - interval {near} second")
    return (f"s.measureddtm > e.edge_time + interval {near} second", f"s.measureddtm < e.edge_time + interval {near + span} second")


def trip_ctes(start=START, end=END) -> str:
    near, far = L.trip_near_s, L.trip_far_s
    stop = edge_ctes("stop_e", "stop", "before", *around(near, far, "stop"), start, end)
    begin = edge_ctes("start_e", "start", "before", *around(near, far, "start"), start, end)
    stuck = _events("stuck", f"{text(names.TRIP_STOP)} as Detail",
                    f"SCPS = {L.stuck_scps} and ICPS = {L.stuck_icps} and (EWDCA > {L.stuck_pv_w} or SLNX = 1) "
                    f"and fridgeid in {SOLAR}", start, end)
    trips = (f"trips as (select fridgeid, edge_time as EventTime, {text(names.TRIP_STOP)} as Detail from stop_e "
             f"where watts < {L.trip_max_w} and fridgeid not in {SOLAR} union all "
             f"select fridgeid, edge_time, {text(names.TRIP_START)} from start_e where watts < {L.trip_max_w} and fridgeid not in {SOLAR})")
    return f"{stop}, {begin}, {stuck}, {trips}"


def thermostat(interval, start=START, end=END):
    ctes = trip_ctes(start, end)
    ms, mm = text(names.SOLAR_STUCK), text(names.TRIP)
    if interval == "All":
        link = device_link("EventTime", "EventTime", 1200)
        a = finding("All", ms, "Detail", "null", "1", "EventTime", link, "stuck")
        b = finding("All", mm, "Detail", "null", "1", "EventTime", link, "trips")
        return ctes, f"{a} union all {b}"
    link = device_link("first_time", "last_time", 1200)
    if interval == "Day":
        parts = []
        for source, m, least in (("stuck", ms, L.stuck_day_min), ("trips", mm, 0)):
            per_detail = f"(select fridgeid, {bucket('Day')} as b, Detail, count(*) as per_detail from {source} group by all)"
            days = (f"{rolled(source, 'Day', 'EventTime, Detail')} join {per_detail} using (fridgeid, b, Detail) "
                    f"where per_detail > {least}")
            parts.append(finding("Day", m, "Detail", "null", "per_detail", "EventTime", link, days))
        return ctes, " union all ".join(parts)
    hours = (f"stuck_weeks as (select fridgeid, b from (select fridgeid, {week('EventTime')} as b, "
             f"date_trunc('hour', EventTime) as h, count(*) as n from stuck group by all having count(*) > {L.stuck_hour_min}) "
             f"group by all having count(*) >= {L.stuck_hours})")
    numbered = (f"trip_weeks as (select *, {week('EventTime')} as b, "
                f"row_number() over (partition by fridgeid, Detail, {week('EventTime')} order by EventTime) as r_min, "
                f"row_number() over (partition by fridgeid, Detail, {week('EventTime')} order by EventTime desc) as r_max from trips)")
    paired = ("(select f.fridgeid, f.Detail, f.EventTime, f.EventTime as first_time, l.EventTime as last_time, c.n "
              "from (select * from trip_weeks where r_min = 1) f join (select * from trip_weeks where r_max = 1) l "
              "on f.fridgeid = l.fridgeid and f.b = l.b join (select fridgeid, b, Detail, count(*) as n from trip_weeks group by all) c "
              "on f.fridgeid = c.fridgeid and f.b = c.b and f.Detail = c.Detail)")
    a = finding("Week", ms, "Detail", "null", "n", "EventTime", link,
                f"{rolled('stuck', 'Week')} join stuck_weeks using (fridgeid, b)")
    b = finding("Week", mm, "Detail", "null", "n", "EventTime", link, paired)
    return f"{ctes}, {hours}, {numbered}", f"{a} union all {b}"


def low_charge(interval, start=START, end=END):
    settle, span = L.charge_settle_s, L.charge_window_s
    edges = edge_ctes("off_e", "stop", "after", *settled(settle, span, "stop"), start, end)
    base = (f"charge as (select fridgeid, edge_time - interval {settle} second as EventTime, ct, watts as value, ambient from off_e "
            f"where ct > {L.charge_min_count} and fridgeid not in {SOLAR})")
    low = f"value >= {L.charge_floor_w} and value < {L.charge_low_w} and ambient < {L.charge_ambient_c}"
    high = f"value >= {L.charge_low_w} and value < {L.charge_high_w} and ambient >= {L.charge_ambient_c}"
    bands = f"charge_low as (select * from charge where {low}), charge_high as (select * from charge where {high})"
    m = text(names.CHARGE)
    if interval == "All":
        a = finding("All", m, text(names.CHARGE_LOW_EVENT), number("value"), "ct", "EventTime",
                    device_link("EventTime", HOUR, 1200), "charge_low")
        b = finding("All", m, text(names.CHARGE_HIGH), number("value"), "ct", "EventTime",
                    device_link("EventTime", "EventTime", 1200), "charge_high")
    else:
        link = device_link("first_time", "last_time", 1200)
        a, b = [finding(interval, m, text(d), number("value"), "n", "EventTime", link, rolled(s, interval, "EventTime, value"))
                for s, d in (("charge_low", names.CHARGE_LOW), ("charge_high", names.CHARGE_HIGH))]
    return f"{edges}, {base}, {bands}", f"{a} union all {b}"


# --- error codes -----------------------------------------------------------------------------


def _inside(column: str) -> str:
    return (f"substring({column}, position('(' in {column}) + 1, position(')' in {column}) - position('(' in {column}) - 1)")


def daq(interval, start=START, end=END):
    codes = ", ".join(f"'{c}'" for c in names.DAQ_CODES)
    w = window("measureddtm", start, end)
    raw = (f"daq as (select fridgeid, id, description as Detail, {_inside('message')} as value, measureddtm as EventTime "
           f"from errors where id in ({codes}) and {w} and position('(' in message) > 0 union all "
           f"select fridgeid, id, description, '1', measureddtm from errors where id = '5884' and {w} and message = '')")
    parts = (f"sensors as (select fridgeid, id, measureddtm as EventTime, case substring(message, 1, position('(' in message) - 1) "
             f"when '0' then 'TEVIN' when '1' then 'DAQ chain' when '2' then 'TCDOUT' "
             f"else substring(message, 1, position('(' in message) - 1) end as name "
             f"from errors where id like '618%' and {w} and position('(' in message) > 0)")
    message = f"{text(names.DAQ_ERROR)} || id"
    if interval == "All":
        a = finding("All", message, "Detail", "value", "1", "EventTime", device_link("EventTime", DAY, 21600), "daq",
                    error_link("EventTime", DAY, 21600, code()))
        b = finding("All", "id", "name", "null", "1", "EventTime", device_link("EventTime", DAY, 21600), "sensors",
                    error_link("EventTime", DAY, 21600, code()))
        return f"{raw}, {parts}", f"{a} union all {b}"
    weeks = (f"daq_weeks as (select *, {week('EventTime')} as b, "
             f"row_number() over (partition by fridgeid, id order by EventTime, Detail) as r_min, "
             f"row_number() over (partition by fridgeid, id order by EventTime desc) as r_max from daq)")
    life = "s.fridgeid = f.fridgeid and s.measureddtm >= f.EventTime and s.measureddtm < f.EventTime + interval 7 day"

    def one(expr: str, also: str = "") -> str:
        return f"(select {expr} from sensor s where {life}{also})"

    on = " and s.SCPX = 1"
    battery = one(f"'[' || {number('max(s.ECDBAT)')} || ',' || {number('min(s.ECDBAT)')} || ']'", on)
    value = (f"case f.id when '5881' then {one(number('max(s.EWCP2)'), on)} "
             f"when '5882' then case when {one('min(s.EWCP2)', on + ' and s.EWCP2 > 1')} > 1 "
             f"then {one(number('min(s.EWCP2)'), on + ' and s.EWCP2 > 1')} else {one(number('min(s.EWCP2)'), on)} end "
             f"when '5889' then {one(number('min(s.TEVIN)'), on)} when '5888' then {one(number('max(s.TCPDISCTL)'))} "
             f"when '5084' then {battery} "
             f"when '5884' then (select cast(sum(cast(x.value as int)) as varchar) from daq_weeks x "
             f"where x.fridgeid = f.fridgeid and x.id = '5884') end")
    firsts = (f"(select f.fridgeid, f.id, f.Detail, f.EventTime, l.EventTime as last_time, c.n, {value} as code_value "
              f"from (select * from daq_weeks where r_min = 1) f "
              f"join (select fridgeid, id, b, count(*) as n from daq_weeks group by all) c "
              f"on c.fridgeid = f.fridgeid and c.id = f.id and c.b = f.b "
              f"join (select * from daq_weeks where r_max = 1) l on l.fridgeid = f.fridgeid and l.id = f.id and l.b = f.b)")
    a = finding("Week", message, "Detail", "code_value", "n", "EventTime", device_link("EventTime", "last_time", 21600), firsts,
                error_link("EventTime", "last_time", 21600, code()))
    listed = ("sensor_lists as (select fridgeid, count(*) as total, string_agg(distinct id, ',' order by id) as ids, "
              "string_agg(distinct name, ',' order by name) as sensor_names, "
              f"'{names.CODE_PARAMETER}' || string_agg(distinct id, '{names.CODE_PARAMETER}' order by id) as codes "
              "from sensors group by fridgeid)")
    b = finding("Week", text(names.SENSOR_ERROR), "ids", "sensor_names", "total", "first_time",
                device_link("first_time", "last_time", 21600),
                f"{rolled('sensors', 'Week')} join sensor_lists using (fridgeid)",
                error_link("first_time", "last_time", 21600, "codes"))
    return f"{raw}, {parts}, {weeks}, {listed}", f"{a} union all {b}"


def statement(pair: tuple[str, str]) -> str:
    return query(f"{pair[0]}\n{pair[1]}")


def all_ctes(start: str, end: str, interval: str = "Day") -> tuple[str, str]:
    """Every detector of the report as one union named ``found``."""
    parts = [
        no_door(start, end), daq("Week", start, end), thermostat("Week", start, end), overlapping("Hour", start, end),
        high_voltage(interval, start, end), low_temperature(interval, start, end), ambient("Week", start, end),
        high_power(interval, start, end), failed_starts("Week", start, end), low_charge(interval, start, end)]
    ctes = ", ".join(p[0] for p in parts)
    return ctes, " union all ".join(p[1] for p in parts)
