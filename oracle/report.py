"""Fleet choice, report assembly and readers in SQL."""

from __future__ import annotations

from . import eng, tech
from .base import BASE, FREEZER, SOLAR, TABLES, _span, device_link, number, text, window, window_days
from .settings import END, EXCLUDED, START
from .values import L, TECH_SLACK

LATEST = ("(select * from (select *, row_number() over (partition by fridgeid order by createddtm desc, location_id desc) as rn "
          "from location_history) where rn = 1)")
ENG_PLACE = ("(select * from (select *, row_number() over (partition by fridgeid order by createddtm desc, location_id desc) as rn "
             f"from location_history where country != '{EXCLUDED}' and fridgeid not in {FREEZER}) where rn = 1)")


def fleet(country: str | None = None) -> str:
    chosen = f"country != '{EXCLUDED}'" if country is None else f"lower(country) = lower('{country}')"
    return (f"(select l.fridgeid, d.FridgeShortSN, case when l.fridgeid in {SOLAR} then 'S' else 'M' end as fridgeType "
            f"from {LATEST} l left join device d using (fridgeid) where {chosen} and l.fridgeid not in {FREEZER})")


def history_fleet() -> str:
    return (f"(select fridgeid, case when fridgeid in {SOLAR} then 'S' else 'M' end as fridgeType from (select *, row_number() over "
            f"(partition by fridgeid order by fridgeid) as rn from location_history where country != '{EXCLUDED}' "
            f"and fridgeid not in {FREEZER}) where rn = 1)")


def eng_report(start: str = START, end: str = END, run_time: str = "", country: str | None = None, interval: str = "Day") -> str:
    ctes, found = eng.all_ctes(start, end, interval)
    return (
        f"(with {ctes}, found as ({found}), chosen as {fleet(country)}, place as {ENG_PLACE} "
        f"select timestamp '{run_time}' as CreatedDtm, p.country as Country, p.L1, p.L3, date '{start}' as StartDate, "
        f"date '{end}' as EndDate, cast({window_days(start, end)} as int) as ReportDays, c.fridgeid as FridgeId, "
        f"upper(c.FridgeShortSN) as FridgeShortSN, c.fridgeType as FridgeType, r.Message, r.Detail, r.value, r.EventTime, r.RecCount, "
        f"r.link as Link, r.MessageInterval, r.Glink as GLink from found r join chosen c on r.fridgeid = c.fridgeid "
        f"left join place p on r.fridgeid = p.fridgeid)")


def new_rows(rows: str, stored: str) -> str:
    return (f"(select t1.* from {rows} t1 left join {stored} t2 on t1.FridgeId = t2.FridgeId and t1.EventTime = t2.EventTime "
            f"and t1.RecCount = t2.RecCount where t2.FridgeId is null)")


def read_eng(report: str, start: str, country: str | None = None) -> str:
    only = f" and lower(Country) = lower('{country}')" if country else ""
    return (f"select Country, L1, L3, StartDate, EndDate, ReportDays, FridgeId, FridgeShortSN, FridgeType, Message, Detail, value, "
            f"strftime(EventTime, '%d-%b-%Y %H:%M:%S') as EventTime, RecCount, case when Message like 'DAQ%' then GLink "
            f"when Message like 'Failed%Start%' then GLink else Link end as Link, MessageInterval from {report} "
            f"where StartDate = date '{start}'{only}")


# --- technician report -----------------------------------------------------------------------


def findings(start: str, end: str, devices: str, rules: str) -> str:
    """CTEs ending in ``found``: all detectors of the rule set behind their class gates."""
    common = [
        (tech.missing_data(start, end), None), (tech.sensor_presence(start, end), None), (tech.low_mains_power(start, end), "M"),
        (tech.low_solar_power(start, end), "S"), (tech.battery_missing(start, end), None), (tech.battery_drain(start, end), None),
        (tech.sd_card_errors(start, end), None), (tech.alarm_days(start, end), None), (tech.line_frequency(start, end), None),
        (tech.refrigerant_leak(start, end), "M"), (tech.solar_low_ice(start, end), "S"), (tech.mech_trips(), "M"),
        (tech.low_temperature(start, end), None), (tech.long_door_open(start, end, "5404", "hour"), None),
        (tech.missing_power_board(start, end), "M"), (tech.missing_control_board(start, end), None)]
    if rules == "v4":
        common += [(tech.missing_usb_board(start, end), None), (tech.duplicate_device(start, end), None)]
    else:
        common += [(tech.dirty_panels(start, end), "S"), (tech.no_solar_power(start, end), "S")]
    union = " union all ".join(
        f"select *, {'null' if only is None else text(only)} as only_class from ({sql})" for sql, only in common)
    return (f"{tech.trip_edges(start, end)}, chosen as {devices}, gated as (select f.fridgeid, f.Priority, f.Message, f.Detail, f.value, "
            f"f.errCnt from ({union}) f join chosen c on f.fridgeid = c.fridgeid where only_class is null or only_class = c.fridgeType)")


def suppressed(rules: str, intended: bool = False) -> str:
    """CTEs from ``gated`` to ``kept``."""
    board = "(select fridgeid from r2 where Message = 'Missing Power Board Data' and value < 1)"
    first = (
        "r1 as (select fridgeid, Priority, case when Message = 'Missing Data' and value = 0 then 'Unit Offline' else Message end as Message, "
        "case when Message = 'Missing Data' and value = 0 then null else Detail end as Detail, "
        "case when Message = 'Missing Data' and value = 0 then null else value end as value, errCnt from gated), "
        "r2 as (select * from r1 where not (fridgeid in (select fridgeid from r1 where Message = 'Unit Offline') "
        "and Message != 'Unit Offline'))")
    if rules == "v4":
        return f"{first}, kept as (select * from r2 where not (fridgeid in {board} and Message != 'Low Mains Power Availability'))"
    doomed = (f"fridgeid in {board} and (Message = 'Low Mains Power Availability' or Message = 'Line Frequency Abnormal')" if intended
              else f"(fridgeid in {board} and Message = 'Low Mains Power Availability') or Message = 'Line Frequency Abnormal'")
    return (
        f"{first}, r3 as (select * from r2 where not ({doomed})), "
        "r4 as (select * from r3 where not (fridgeid in (select fridgeid from r3 where Message = 'Low Mains Power Availability' "
        "and value < 1) and Message = 'Line Frequency Abnormal')), "
        "kept as (select * from r4 where not (fridgeid in (select fridgeid from r4 where Message = 'Solar Power Disconnected') "
        "and Message = 'Low Solar Power'))")


def kept_findings(start: str, end: str, rules: str = "v6", intended: bool = False) -> str:
    return f"{TABLES}, {findings(start, end, fleet(), rules)}, {suppressed(rules, intended)} select * from kept"


def _age(seconds: str) -> str:
    return f"((({seconds}) // 86400) || 'd ' || ((({seconds}) % 86400) // 3600) || 'h')"


def tech_report(start: str = START, end: str = END, rules: str = "v6", country: str | None = None, intended: bool = False) -> str:
    devices = fleet(country) if rules == "v6" else history_fleet()
    expected = f"{L.samples_per_day * window_days(start, end)}::double"
    inside = f"s.fridgeid = r.fridgeid and {window('s.measureddtm', start, end)}"

    def one(expr: str) -> str:
        return f"(select {expr} from sensor s where {inside})"

    low = L.legacy_volt_min if rules == "v4" else L.volt_min
    alone = "" if rules == "v4" else "when avg(s.TVCBOT) is null then round(avg(s.TVCTOPCTL), 1) "
    average = one("case when avg(s.TVCTOPCTL) is null and avg(s.TVCBOT) is null then null "
                  f"when avg(s.TVCTOPCTL) is null then round(avg(s.TVCBOT), 1) {alone}"
                  "else round((avg(s.TVCTOPCTL) + avg(s.TVCBOT)) / 2.0, 1) end")
    holdover = (f"coalesce(round((select s.CTBH from sensor s where {inside} order by s.measureddtm desc, s.event_id desc limit 1), 1), 0)"
                if rules == "v6" else f"round({one('coalesce(avg(s.CTBH), 0)')}, 1)")
    supply = one(f"coalesce(sum(case when s.SLNX = 1 or (s.SLNX is null and s.EVLN > {low} and s.EVLN < {L.volt_max}) "
                 f"or s.EWDCA > {L.pv_ok_w} then 1 else 0 end), 0)")
    received = (f"round({one('count(s.measureddtm)')} / {expected} * 100.0, 1)" if rules == "v4"
                else "(select round(pct, 1) from rx where rx.fridgeid = r.fridgeid)")
    age = _age(f"cast(epoch(timestamp '{end}') - epoch((select max(s.measureddtm) from sensor s where s.fridgeid = r.fridgeid "
               f"and s.measureddtm < timestamp '{end}')) as bigint)")
    fridgeid = "fridgeid"
    link = (f"(case when r.fridgeid in {SOLAR} then '{BASE.device_solar}' else '{BASE.device_mains}' end) || d.fridgeid"
            if rules == "v4" else
            device_link(f"timestamp '{start}'", f"timestamp '{end}'", TECH_SLACK).replace(f"|| {fridgeid} ||", "|| d.fridgeid ||").replace(
                "when fridgeid in", "when d.fridgeid in"))
    offline = "r.Message = 'Unit Offline'"
    rows = (
        f"select {'cast(null as varchar)' if rules == 'v4' else 'r.Priority'} as Priority, p.country as Country, p.L1, p.L3, "
        f"date '{start}' as StartDate, date '{end}' as EndDate, cast({window_days(start, end)} as int) as ReportDays, d.fridgeid as FridgeId, "
        f"upper(d.FridgeShortSN) as FridgeShortSN, case when d.fridgeid in {SOLAR} then 'S' else 'M' end as FridgeType, "
        f"case when p.report = 1 then 'Y' end as Deployed, p.commDte, r.Message, r.Detail, r.value, "
        f"cast({average} as double) as TVCTOPCTLavg, cast(case when {offline} then null else {holdover} end as double) as CTBH, "
        f"cast(case when {offline} then null else round({supply} / {expected} * 100.0, 1) end as double) as SLNX, "
        f"cast({received} as double) as DataRx, run.runAgeMin as CompRunAgeMin, {_age('run.runAgeMin * 60')} as CompRunAge, {age} as DataAge, "
        f"{link} as Link from kept r left join device d on r.fridgeid = d.fridgeid left join place p on r.fridgeid = p.fridgeid "
        f"left join last_run run on r.fridgeid = run.fridgeid")
    final = "select * from filled_report"
    if rules == "v6":
        final += (" where not (FridgeId in (select FridgeId from filled_report where DataRx > 0 and DataRx < 1) "
                  "and Message != 'Missing Data')")
    return (f"(with {findings(start, end, devices, rules)}, {suppressed(rules, intended)}, place as {LATEST}, rx as {tech.data_rx(start, end)}, "
            f"{tech.last_run(start, end)}, filled_report as ({rows}) {final})")


def read_tech(report: str, start: str, end: str, digits: int, country: str | None = None) -> str:
    only = f" and lower(Country) = lower('{country}')" if country else ""
    return (f"select * replace (round(value, {digits}) as value, round(CTBH, 0) as CTBH, round(SLNX, 0) as SLNX, round(DataRx, 0) as DataRx) "
            f"from {report} where StartDate = date '{start}' and EndDate = date '{end}'{only}")


def statement(select: str) -> str:
    return f"{TABLES}\n{select}"
