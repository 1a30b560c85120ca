"""The catalogue: query name -> (Spark callable, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from coldtrail.functions import links, text, timebucket
from coldtrail.operators import eng, tech
from coldtrail.operators.asof import next_day_pairs
from coldtrail.operators.edges import charge_frame, edge_power, trip_frames
from coldtrail.operators.findings import TECH_COLUMNS, device_flags, render, with_class
from coldtrail.operators.islands import bucket_islands
from coldtrail.operators.profile import counters, derived, device_profile
from coldtrail.operators.runs import last_compressor_run
from coldtrail.plans import jobs, readers
from coldtrail.plans.eng_report import eng_report
from coldtrail.plans.fleet import eng_location, fleet, history_fleet, latest_location
from coldtrail.plans.last_seen import last_seen
from coldtrail.plans.tech_report import tech_findings, tech_report
from coldtrail.schema import REPORT_ENG, REPORT_TECH
from coldtrail.sources.events_adapter import fleet_from_events
from coldtrail.sources.sinks import read_report
from coldtrail.sources.tables import STORED_TIME, FleetTables, error_rows, read_sim_billing, readings
from coldtrail.sources.workspace import shared_folder

from . import eng as eng_sql
from . import report as report_sql
from . import tech as tech_sql
from .base import SOLAR, code, device_link, error_link, number, query, slot, week, window
from .settings import (
    COUNTRY, END, EXCLUDED, LAST_DAY, LIMITS, RUN_BEFORE, RUN_TIME, START, TECH_RUN_TIME, WEEK_END, WEEK_START)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def fleet_of(spark: SparkSession, folder: str) -> FleetTables:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return fleet_from_events(spark, folder)


def register(name: str, build: Callable[[FleetTables], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, folder: build(fleet_of(spark, folder))
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _eng(name: str, operator, sql, *intervals: str, window=(START, END)) -> None:
    for interval in intervals:
        def build(t: FleetTables, interval=interval) -> DataFrame:
            return render(operator(t, *window, interval, LIMITS), t.device_group)

        pair = sql(interval)
        register(f"{name}_{interval.lower()}", build, eng_sql.statement(pair))


_eng("bad_time", eng.bad_time, eng_sql.bad_time, "All", "Day", "Week")
_eng("failed_starts", eng.failed_starts, eng_sql.failed_starts, "All", "Day", "Week")
_eng("high_compressor_power", eng.high_compressor_power, eng_sql.high_power, "All", "Day")
_eng("high_voltage", eng.high_voltage, eng_sql.high_voltage, "All", "Day")
_eng("low_temperature_events", eng.low_temperature, eng_sql.low_temperature, "All", "Day")
_eng("ambient_extremes", eng.ambient_extremes, eng_sql.ambient, "All", "Week")
_eng("overlapping_data", eng.overlapping_data, eng_sql.overlapping, "All", "Hour")
_eng("mech_thermostat", eng.mech_thermostat, eng_sql.thermostat, "All", "Day", "Week")
_eng("low_charge", eng.low_charge, eng_sql.low_charge, "All", "Day", "Week")
_eng("daq_errors", eng.daq_errors, eng_sql.daq, "All", "Week")
_eng("no_door_openings", eng.no_door_openings, lambda interval: eng_sql.no_door(WEEK_START, WEEK_END), "Week",
     window=(WEEK_START, WEEK_END))


def _rule(name: str, sql: Callable[..., str], rules: tuple[str, ...] = (), window=(START, END)) -> None:
    register(name, lambda t: tech.detect(rules or (name,), t, t.device, *window, LIMITS), tech_sql.statement(sql(*window)))


for _name in ("missing_data", "low_mains_power", "low_solar_power", "dirty_panels", "no_solar_power", "battery_missing", "line_frequency",
              "refrigerant_leak", "missing_power_board", "missing_control_board", "missing_usb_board", "missing_holdover",
              "duplicate_device"):
    _rule(_name, getattr(tech_sql, _name))
for _name in tech.SENSOR_PRESENCE:
    _rule(_name, lambda start, end, only=_name: tech_sql.sensor_presence(start, end, only))
_rule("sensor_presence", tech_sql.sensor_presence, tech.SENSOR_PRESENCE)
_rule("low_temperature_days", tech_sql.low_temperature, ("low_temperature",))
_rule("low_temperature_days_both_sensors", lambda start, end: tech_sql.low_temperature(start, end, True), ("low_temperature_any",))
_rule("solar_low_ice", tech_sql.solar_low_ice, ("solar_undersatisfied", "solar_no_ice"), (WEEK_START, WEEK_END))


def _tech(name: str, build: Callable[[FleetTables], DataFrame], sql: str, ctes: str = "") -> None:
    register(name, lambda t: build(t).drop("only_class"), tech_sql.statement(sql, ctes))


_tech("battery_drain", lambda t: tech.battery_drain(t, START, END, LIMITS), tech_sql.battery_drain())
_tech("first_battery_pair", lambda t: tech.first_battery_pair(t, START, END, LIMITS), tech_sql.first_battery_pair())
_tech("alarm_days", lambda t: tech.alarm_days(t, START, END), tech_sql.alarm_days())
_tech("sd_card_errors", lambda t: tech.sd_card_errors(t, START, END, LIMITS), tech_sql.sd_card_errors())
_tech("long_door_open", lambda t: tech.long_door_open(t, START, END, LIMITS, None, "Day"), tech_sql.long_door_open())
_tech("mech_trips", lambda t: tech.mech_trips(t, START, END, LIMITS), tech_sql.mech_trips(), tech_sql.trip_edges())
_SLOW = tech_sql.trip_edges(near=LIMITS.slow_trip_near_s, span=LIMITS.slow_trip_span_s)
_tech("mech_trips_slow_start", lambda t: tech.mech_trips_slow_start(t, START, END, LIMITS),
      tech_sql.mech_trips(("t_start",), LIMITS.slow_trip_min_count), _SLOW)
_tech("mech_trips_slow_stop", lambda t: tech.mech_trips_slow_stop(t, START, END, LIMITS, literal=False),
      tech_sql.mech_trips(("t_stop",), LIMITS.slow_trip_min_count), _SLOW)


# --- the forms that need hourly alarms and ten-second readings, over tables derived from the events ---


def _with(t: FleetTables, **other: DataFrame) -> FleetTables:
    names = ("sensor", "errors", "bad_time_errors", "location_history", "device", "device_group")
    return FleetTables(**{name: getattr(t, name) for name in names} | other)


def _hourly_alarms(t: FleetTables) -> FleetTables:
    """Every door alarm repeats each hour, up to 23 times."""
    last = F.when(F.col("id") == "5404", F.floor(F.unix_seconds("measureddtm") / 60) % 24).otherwise(0)
    rows = t.errors.drop(STORED_TIME).withColumn("hour", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    return _with(t, errors=rows.withColumn("measureddtm", F.expr("timestamp_seconds(unix_seconds(measureddtm) + hour * 3600)")).drop("hour"))


def _bursts(t: FleetTables) -> FleetTables:
    """Every reading starts ten minutes of readings ten seconds apart, running for the first seven and a half."""
    rows = t.sensor.drop(STORED_TIME).withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(59).cast("bigint"))))
    return _with(t, sensor=rows.withColumns({
        "measureddtm": F.expr("timestamp_seconds(unix_seconds(measureddtm) + step * 10)"), "reading_id": F.col("reading_id") * 60 + F.col("step"),
        "SCPX": F.when(F.col("step") < 45, 1).otherwise(0)}).drop("step"))


def _alarms_sql(statement: str) -> str:
    hours = "case when id = '5404' then cast(epoch(measureddtm) as bigint) // 60 % 24 else 0 end"
    again = (f"errors as (select fridgeid, measureddtm + to_hours(cast(hour as int)) as measureddtm, id, description, message "
             f"from (select *, unnest(range(0, {hours} + 1)) as hour from plain_errors)),")
    return statement.replace("\nerrors as (", "\nplain_errors as (", 1).replace("\nbad_time_errors as (", f"\n{again}\nbad_time_errors as (", 1)


def _bursts_sql(statement: str) -> str:
    again = ("sensor as (select * replace (measureddtm + to_seconds(cast(step * 10 as int)) as measureddtm, event_id * 60 + step as event_id, "
             "case when step < 45 then 1 else 0 end as SCPX) from (select *, unnest(range(0, 60)) as step from plain_sensor)),")
    return statement.replace("\nsensor as (", "\nplain_sensor as (", 1).replace("\nerrors as (", f"\n{again}\nerrors as (", 1)


def _literal_stops(t: FleetTables) -> DataFrame:
    """Stops by the literal rules, and whether the literal sum of stops and starts finds the device."""
    dense = _bursts(t)
    found = tech.mech_trips_slow_stop(dense, START, END).select("fridgeid", F.lit(True).alias("found"))
    return tech.slow_stops(dense, START, END).join(found, "fridgeid", "left").select("fridgeid", "events", F.coalesce("found", F.lit(False)).alias("found"))


register("long_door_open_hours", lambda t: tech.long_door_open(_hourly_alarms(t), START, END).drop("only_class"),
         _alarms_sql(tech_sql.statement(tech_sql.long_door_open(codes="5404", interval="hour", limit=11))))
register("tech_report_door_alarms", lambda t: doubles(tech_report(_hourly_alarms(t), START, END, limits=LIMITS, excluded=EXCLUDED)),
         _alarms_sql(report_sql.statement(f"select * from {report_sql.tech_report(START, END)}")))
register("mech_trips_slow_stop_literal", _literal_stops, _bursts_sql(tech_sql.statement(
    "select fridgeid, count(*) as events, false as found from t_stop where watts < 1 and ct > 20 group by fridgeid", tech_sql.trip_edges(near=120, span=300))))
_tech("mech_trip_times", lambda t: tech.mech_trip_times(t, START, END, LIMITS),
      f"select fridgeid, edge_time as dtm from stop_e where watts < {LIMITS.trip_max_w} union all "
      f"select fridgeid, edge_time from start_e where watts < {LIMITS.trip_max_w}", eng_sql.trip_ctes())
_tech("last_compressor_run", lambda t: last_compressor_run(t.sensor, START, END, LIMITS), "select * from last_run", tech_sql.last_run())
_tech("data_rx_value", lambda t: tech.data_rx(t, t.device, START, END, LIMITS).selectExpr("fridgeid", "cast(dataRx as double) as dataRx"),
      f"select fridgeid, round(pct, 1) as dataRx from {tech_sql.data_rx(START, END)}")


# --- fleets and reports ----------------------------------------------------------------------


def doubles(rows: DataFrame) -> DataFrame:
    """Decimals as doubles, the type the SQL side yields."""
    return rows.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name) for f in rows.schema])


_TECH_ARGS = {"limits": LIMITS, "excluded": EXCLUDED}

register("latest_location", lambda t: latest_location(t.location_history),
         report_sql.statement(f"select fridgeid, createddtm, country, L1, L3, commDte, report from {report_sql.LATEST}"))
register("eng_location", lambda t: eng_location(t, EXCLUDED),
         report_sql.statement(f"select fridgeid, createddtm, country, L1, L3, commDte, report from {report_sql.ENG_PLACE}"))
register("fleet_all", lambda t: fleet(t, "All", EXCLUDED), report_sql.statement(f"select * from {report_sql.fleet()}"))
register("fleet_country", lambda t: fleet(t, f" {COUNTRY.lower()} ", EXCLUDED),
         report_sql.statement(f"select * from {report_sql.fleet(COUNTRY)}"))
register("fleet_history", lambda t: history_fleet(t, EXCLUDED), report_sql.statement(f"select * from {report_sql.history_fleet()}"))

register("eng_report", lambda t: eng_report(t, START, END, run_time=RUN_TIME, **_TECH_ARGS),
         report_sql.statement(f"select * from {report_sql.eng_report(START, END, RUN_TIME)}"))
register("eng_report_events", lambda t: eng_report(t, START, END, COUNTRY, "All", run_time=RUN_TIME, **_TECH_ARGS),
         report_sql.statement(f"select * from {report_sql.eng_report(START, END, RUN_TIME, COUNTRY, 'All')}"))
for _rules in ("v4", "v5", "v6"):
    register(f"tech_report_{_rules}", lambda t, r=_rules: doubles(tech_report(t, START, END, rules=r, **_TECH_ARGS)),
             report_sql.statement(f"select * from {report_sql.tech_report(START, END, _rules)}"))
register("tech_report_one_day", lambda t: doubles(tech_report(t, LAST_DAY, END, **_TECH_ARGS)),
         report_sql.statement(f"select * from {report_sql.tech_report(LAST_DAY, END)}"))
register("tech_report_country", lambda t: doubles(tech_report(t, START, END, COUNTRY, **_TECH_ARGS)),
         report_sql.statement(f"select * from {report_sql.tech_report(START, END, country=COUNTRY)}"))
for _intended in (False, True):
    register(f"suppressed_findings_{'intended' if _intended else 'literal'}",
             lambda t, i=_intended: tech_findings(t, fleet(t, "All", EXCLUDED), START, END, "v6", LIMITS, i).select(*TECH_COLUMNS),
             report_sql.kept_findings(START, END, "v6", _intended))


# --- scans, expressions and building blocks --------------------------------------------------

register("sensor_scan", lambda t: readings(t.sensor, START, END, "reading_id", "SCPX", "EWCP2", "EVLN", "EWDCA"),
         report_sql.statement("select fridgeid, measureddtm, event_id as reading_id, SCPX, EWCP2, EVLN, EWDCA from sensor "
                              f"where {window('measureddtm')}"))
register("error_code_scan", lambda t: error_rows(t.errors, START, END, eng.DAQ_CODES),
         report_sql.statement("select fridgeid, id, description, message, measureddtm from errors where id in "
                              f"({', '.join(map(repr, eng.DAQ_CODES))}) and {window('measureddtm')}"))
register("location_scan", lambda t: t.location_history,
         report_sql.statement("select fridgeid, createddtm, country, L1, L3, commDte, report, location_id from location_history"))
register("device_classes", lambda t: device_flags(t.device_group),
         report_sql.statement("select fridgeid, bool_or(GroupName = 'solar') as is_solar, bool_or(GroupName = 'freezer') as is_freezer "
                              "from device_group group by fridgeid"))


def _time_buckets(t: FleetTables) -> DataFrame:
    at = F.col("measureddtm")
    names = {"Minute": "minute", "10Minute": "ten_minutes", "Hour": "hour", "Day": "day", "Week": "week"}
    return t.sensor.select(
        "fridgeid", "reading_id", at, *[timebucket.bucket(at, i).alias(n) for i, n in names.items()],
        *[timebucket.boundary_diff(u, at, timebucket.ts_lit(END)).alias(f"{u}s_left") for u in ("second", "minute", "hour", "day")],
        F.year(at).alias("year"), F.month(at).alias("month"), F.dayofmonth(at).alias("dom"), F.hour(at).alias("hod"),
        F.to_date(at).alias("date"), (timebucket.epoch(at) - 1200).alias("epoch_from"), (at + F.expr("interval 1 day")).alias("next_day"),
        timebucket.report_time(at).alias("shown"),
        timebucket.days_hours(timebucket.boundary_diff("second", at, timebucket.ts_lit(END))).alias("age"))


_LEFT = ", ".join(f"datediff('{u}', measureddtm, timestamp '{END}') as {u}s_left" for u in ("second", "minute", "hour", "day"))
register("time_buckets", _time_buckets, report_sql.statement(
    f"""select fridgeid, event_id as reading_id, measureddtm, date_trunc('minute', measureddtm) as minute,
    time_bucket(interval 10 minute, measureddtm, timestamp '2016-01-01') as ten_minutes, date_trunc('hour', measureddtm) as hour,
    date_trunc('day', measureddtm) as day, {week('measureddtm')} as week, {_LEFT}, cast(year(measureddtm) as int) as year,
    cast(month(measureddtm) as int) as month, cast(day(measureddtm) as int) as dom, cast(hour(measureddtm) as int) as hod,
    cast(measureddtm as date) as date, cast(epoch(measureddtm) as bigint) - 1200 as epoch_from, measureddtm + interval 1 day as next_day,
    strftime(measureddtm, '%d-%b-%Y %H:%M:%S') as shown,
    (datediff('second', measureddtm, timestamp '{END}') // 86400) || 'd '
      || ((datediff('second', measureddtm, timestamp '{END}') % 86400) // 3600) || 'h' as age from sensor"""))


def _message_parts(t: FleetTables) -> DataFrame:
    m = F.col("message")
    spaced = F.concat(m, F.lit(" seen"))
    return t.errors.select(
        "fridgeid", "measureddtm", "id", text.inside_parentheses(m).alias("inside"), text.before_parenthesis(m).alias("sensor"),
        text.before_space(m).alias("first_word"), text.before_space(spaced).alias("first_word_spaced"),
        text.to_count(text.inside_parentheses(m)).alias("count"), F.upper(F.trim("description")).alias("shown"),
        F.coalesce(text.to_count(m), F.lit(0)).alias("zero"))


register("message_parts", _message_parts, report_sql.statement(
    """select fridgeid, measureddtm, id, regexp_extract(message, '[(]([^)]*)[)]', 1) as inside, split_part(message, '(', 1) as sensor,
    case when position(' ' in message) = 0 then '' else split_part(message, ' ', 1) end as first_word,
    split_part(message || ' seen', ' ', 1) as first_word_spaced,
    try_cast(regexp_extract(message, '[(]([^)]*)[)]', 1) as int) as count, upper(trim(description)) as shown,
    coalesce(try_cast(message as int), 0) as zero from errors"""))

register("rounded_values", lambda t: t.sensor.select(
    "fridgeid", "reading_id", text.rounded(F.col("EVLN"), 8, 1).cast("double").alias("one"),
    text.rounded(F.col("EVLN"), 8, 0).cast("double").alias("whole"),
    F.expr(tech.fixed("-EVLN", 6, 1)).alias("negative"), text.number_text(F.col("EVLN")).alias("shown"),
    text.ratio_pct(F.col("ICPS"), F.col("SLNX")).alias("pct")),
    report_sql.statement("select fridgeid, event_id as reading_id, round(EVLN, 1) as one, round(EVLN, 0) as whole, round(-EVLN, 1) as negative, "
                         f"{number('EVLN')} as shown, case when SLNX = 0 then 0 else ICPS::double / SLNX * 100 end as pct from sensor"))


def _chart_links(t: FleetTables) -> DataFrame:
    rows = with_class(t.sensor.select("fridgeid", "reading_id", "measureddtm"), t.device_group)
    device, solar, at = F.col("fridgeid"), F.col("is_solar"), F.col("measureddtm")
    end = timebucket.ts_lit(END)
    return rows.select(
        "fridgeid", "reading_id", links.link_point(device, solar, at, 1200).alias("point"),
        links.link_range(device, solar, at, end, 28800).alias("span"), links.link_plain(device, solar).alias("plain"),
        links.link_errors(device, solar, F.lit(links.CODE_PARAMETER + "E0A1"), at, end, 1200).alias("errors"))


register("chart_links", _chart_links, report_sql.statement(
    f"""select fridgeid, event_id as reading_id, {device_link('measureddtm', 'measureddtm', 1200)} as point,
    {device_link('measureddtm', f"timestamp '{END}'", 28800)} as span,
    (case when fridgeid in {SOLAR} then '{links.DEFAULT_BASE.device_solar}' else '{links.DEFAULT_BASE.device_mains}' end) || fridgeid as plain,
    {error_link('measureddtm', f"timestamp '{END}'", 1200, code("'E0A1'"))} as errors from sensor"""))

_FRAMES = [*trip_frames(LIMITS), charge_frame(LIMITS)]
register("edge_power", lambda t: _rounded(edge_power(t.sensor, START, END, _FRAMES), "avg_w", "avg_ambient"), eng_sql.statement((
    eng_sql.trip_ctes() + ", " + eng_sql.low_charge("Day")[0],
    " union all ".join(
        f"select fridgeid, '{name}' as name, {at} as EventTime, ct as samples, round(watts, 4) as avg_w, round(ambient, 4) as avg_ambient from {cte}"
        for name, at, cte in (("stop_trip", "edge_time", "stop_e"), ("start_trip", "edge_time", "start_e"),
                              ("charge", f"edge_time - interval {LIMITS.charge_settle_s} second", "off_e"))))))
register("next_day_pairs", lambda t: next_day_pairs(t.sensor, START, END, LIMITS), tech_sql.statement(
    f"select fridgeid, dtm1 as startDtm, dtm2 as endDtm, b1 as battStart, b2 as battEnd, b2 - b1 as battDiff from {tech_sql._pairs(START, END)}"))
register("last_door_opening", lambda t: eng.last_door_opening(t, END, LIMITS), report_sql.statement(
    f"select fridgeid, max(measureddtm) as last_time from sensor where SDXC > 0 and measureddtm < timestamp '{END}' "
    f"and measureddtm >= timestamp '{END}' - interval {LIMITS.door_lookback_days} day group by fridgeid"))
register("alarm_islands", lambda t: bucket_islands(error_rows(t.errors, START, END), "Day"), report_sql.statement(
    f"""select fridgeid, island, count(*) as length from (select *, cast(sum(g) over (partition by fridgeid order by b) as bigint) as island from (
    select *, case when gap is null or gap = 1 then 0 else 1 end as g from (
    select *, datediff('day', b, lead(b) over (partition by fridgeid order by b)) as gap from (
    select distinct fridgeid, date_trunc('day', measureddtm) as b from errors where {window('measureddtm')})))) group by all"""))


_SUMS = {"TVCTOPCTL": "top_sum", "TVCBOT": "bottom_sum", "CTBH": "ctbh_sum"}


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    """Sums and averages to four places: engines add in different orders."""
    return rows.withColumns({c: F.round(c, 4) for c in columns})


def _profile_sql() -> str:
    volt = f"EVLN > {LIMITS.volt_min} and EVLN < {LIMITS.volt_max}"
    legacy = f"SLNX = 1 or (SLNX is null and EVLN > {LIMITS.legacy_volt_min} and EVLN < {LIMITS.volt_max})"
    wide = f"SLNX = 1 or (SLNX is null and {volt})"
    pv = f"EWDCA > {LIMITS.pv_ok_w}"
    run = f"EWCP2 > {LIMITS.leak_min_w} and SCPX = 1"
    cold = f"TVCTOPCTL < {LIMITS.low_temp_c}"
    counted = {
        "volt_ok": volt, "hz_bad": f"{volt} and (EHZLN < {LIMITS.hz_min} or EHZLN > {LIMITS.hz_max})", "mains_ok": legacy, "low_top": cold,
        "low_any": f"{cold} or TVCBOT < {LIMITS.low_temp_c}", "leak_low": f"{run} and EWCP2 < {LIMITS.leak_max_w}", "leak_all": run,
        "state_6": "SCPX = 6", "state_2": "SCPX = 2", "slnx_on": "SLNX = 1", "solar_ok": f"{legacy} or {pv}",
        "supply_ok": f"{wide} or {pv}", "pv_on": f"EWDCA > {LIMITS.zero_pv_w}"}
    w = window("s.measureddtm")
    day = "date_trunc('day', s.measureddtm)"
    columns = [f"count({c}) as {c.lower()}_n" for c in ("SCPX", "EVLN", "TAMDAQ", "TVCTOPCTL", "TICMCTL", "TICBKCTL", "CTBH", "TVCBOT")]
    columns += [f"cast(sum(case when {sql} then 1 else 0 end) as bigint) as {name}" for name, sql in counted.items()]
    columns += [
        "count(*) as n", *[f"round(sum({c}), 4) as {name}" for c, name in _SUMS.items()], "max(EVDBAT) as battery_max",
        "max(EWDCA) as pv_max", "max(measureddtm) as last_time", f"count(distinct {slot('measureddtm', 600)}) as slots",
        f"count(distinct case when {cold} then date_trunc('day', measureddtm) end) as low_days",
        f"count(distinct case when {counted['low_any']} then date_trunc('day', measureddtm) end) as low_any_days"]
    hours = (f"(select count(*) from (select max(s.EVDBAT) as v from sensor s where s.fridgeid = p.fridgeid and {w} "
             f"group by date_trunc('hour', s.measureddtm)) where v < {LIMITS.battery_volt})")
    days = (f"(select count(*) from (select count(*) as c from sensor s where s.fridgeid = p.fridgeid and {w} group by {day}) "
            f"where c > {LIMITS.duplicate_per_day})")
    latest = f"(select s.CTBH from sensor s where s.fridgeid = p.fridgeid and {w} order by s.measureddtm desc, s.event_id desc limit 1)"
    return (f"select *, {hours} as battery_hours, {days} as duplicate_days, {latest} as ctbh_last from "
            f"(select fridgeid, {', '.join(columns)} from sensor where {window('measureddtm')} group by fridgeid) p")


register("device_profile", lambda t: _rounded(
    device_profile(t, START, END, set(counters(LIMITS)) | set(derived(LIMITS)), LIMITS).drop("last_key"), *_SUMS.values()),
         report_sql.statement(_profile_sql()))


# --- stored tables ---------------------------------------------------------------------------


def _billing(t: FleetTables) -> DataFrame:
    """A billing table derived from the location records, stored and scanned with the declared schema."""
    month = F.to_date(F.date_trunc("month", "createddtm"))
    rows = t.location_history.select(
        F.concat(F.lit("sub-"), F.col("fridgeid")).alias("SUBSCRIBER_ID"), F.col("fridgeid").alias("DEVICE_ID"),
        (F.col("location_id") + 10**14).alias("IMSI"), F.concat(F.lit("89"), F.col("location_id")).alias("ICCID"),
        F.col("location_id").alias("MSISDN"), F.date_format("createddtm", "yyyyMM").cast("int").alias("BILL_PERIOD"),
        F.year("createddtm").alias("BILL_PERIOD_YR"), F.month("createddtm").alias("BILL_PERIOD_MO"), F.col("L3").alias("BILL_STATUS"),
        month.alias("BILL_STATUS_START"), F.last_day(month).alias("BILL_STATUS_END"), F.lit("Z").alias("HOME_ZONE"),
        F.col("L1").alias("ZONE_NAME"), month.alias("RATE_PLAN_START"), F.last_day(month).alias("RATE_PLAN_END"),
        F.dayofmonth(F.last_day(month)).alias("ACTIVE_DAYS_IN_PLAN"), F.lit(1.0).alias("PRORATE_FACTOR"),
        F.col("report").alias("BILL_PKT_KB"), (F.col("report") * 0.5).alias("BILL_PKT_PRICE"),
        (F.col("report") * 0.5).alias("BILL_TOTAL_TRAFFIC_CHARGES"))
    path = shared_folder(rows.sparkSession, "sim-billing")
    rows.write.parquet(path)
    return read_sim_billing(rows.sparkSession, path)


_MONTH = "cast(date_trunc('month', createddtm) as date)"
register("sim_billing_scan", _billing, report_sql.statement(
    f"""select 'sub-' || fridgeid as SUBSCRIBER_ID, fridgeid as DEVICE_ID, location_id + 100000000000000 as IMSI, '89' || location_id as ICCID,
    location_id as MSISDN, cast(strftime(createddtm, '%Y%m') as int) as BILL_PERIOD, cast(year(createddtm) as int) as BILL_PERIOD_YR,
    cast(month(createddtm) as int) as BILL_PERIOD_MO, L3 as BILL_STATUS, {_MONTH} as BILL_STATUS_START, last_day(createddtm) as BILL_STATUS_END,
    'Z' as HOME_ZONE, L1 as ZONE_NAME, {_MONTH} as RATE_PLAN_START, last_day(createddtm) as RATE_PLAN_END,
    cast(day(last_day(createddtm)) as int) as ACTIVE_DAYS_IN_PLAN, 1.0::double as PRORATE_FACTOR, report as BILL_PKT_KB,
    report * 0.5::double as BILL_PKT_PRICE, report * 0.5::double as BILL_TOTAL_TRAFFIC_CHARGES from location_history"""))


def _stored_eng(t: FleetTables) -> DataFrame:
    """Two overlapping weekly runs into one table, the first of them twice."""
    spark = t.sensor.sparkSession
    path = shared_folder(spark, "report-eng")
    for run_time in (RUN_BEFORE, RUN_BEFORE, RUN_TIME):
        jobs.run_weekly_eng(t, path, run_time, **_TECH_ARGS)
    return read_report(spark, path, REPORT_ENG)


def _window_of(window) -> tuple[str, str]:
    return tuple(day.isoformat() for day in window)


_W1, _W2 = _window_of(readers.eng_window(RUN_BEFORE)), _window_of(readers.eng_window(RUN_TIME))
_ENG_FIRST = report_sql.eng_report(*_W1, RUN_BEFORE)
_ENG_SECOND = report_sql.new_rows(report_sql.eng_report(*_W2, RUN_TIME), "(select * from first_run)")
_ENG_STORED = f"first_run as (select * from {_ENG_FIRST}), stored as (select * from first_run union all select * from {_ENG_SECOND})"
register("eng_report_stored", _stored_eng, query(f"{_ENG_STORED} select * from stored"))
register("eng_report_read", lambda t: readers.read_eng(_stored_eng(t), RUN_TIME),
         query(f"{_ENG_STORED} {report_sql.read_eng('stored', _W2[0])}"))
register("eng_report_read_country", lambda t: readers.read_eng(_stored_eng(t), RUN_TIME, COUNTRY),
         query(f"{_ENG_STORED} {report_sql.read_eng('stored', _W2[0], COUNTRY)}"))
register("eng_report_rows_per_start", lambda t: readers.rows_per_start(_stored_eng(t)),
         query(f"{_ENG_STORED} select StartDate, count(*) as rows from stored group by StartDate"))


def _stored_tech(t: FleetTables) -> DataFrame:
    """Two weekly runs: the second replaces the whole table."""
    spark = t.sensor.sparkSession
    path = shared_folder(spark, "report-tech")
    for run_time in (RUN_BEFORE, TECH_RUN_TIME):
        jobs.run_weekly_tech(t, path, run_time, **_TECH_ARGS)
    return readers.read_tech(read_report(spark, path, REPORT_TECH), TECH_RUN_TIME)


def _second_run(t: FleetTables) -> DataFrame:
    """A run whose last readings come from the state table that an earlier run left, by way of a gap of days."""
    spark = t.sensor.sparkSession
    path = shared_folder(spark, "report-tech")
    last_seen(t, f"{path}_last_seen", readers.tech_window(RUN_BEFORE)[0])
    jobs.run_weekly_tech(t, path, TECH_RUN_TIME, **_TECH_ARGS)
    return readers.read_tech(read_report(spark, path, REPORT_TECH), TECH_RUN_TIME)


def _refreshed_tech(t: FleetTables, country: str) -> DataFrame:
    """One country loaded once although asked for twice, then all countries over it."""
    path = shared_folder(t.sensor.sparkSession, "report-tech")
    for _ in range(2):
        shown = jobs.refreshed_tech(t, path, TECH_RUN_TIME, COUNTRY, **_TECH_ARGS)
    return shown if country == COUNTRY else jobs.refreshed_tech(t, path, TECH_RUN_TIME, country, **_TECH_ARGS)


_W3 = _window_of(readers.tech_window(TECH_RUN_TIME))
register("tech_report_stored", lambda t: doubles(_stored_tech(t)),
         report_sql.statement(report_sql.read_tech(report_sql.tech_report(*_W3), *_W3, 1)))
register("tech_report_second_run", lambda t: doubles(_second_run(t)),
         report_sql.statement(report_sql.read_tech(report_sql.tech_report(*_W3), *_W3, 1)))
register("tech_report_refreshed", lambda t: doubles(_refreshed_tech(t, "All")),
         report_sql.statement(report_sql.read_tech(report_sql.tech_report(*_W3), *_W3, 0)))
register("tech_report_refreshed_country", lambda t: doubles(_refreshed_tech(t, COUNTRY)),
         report_sql.statement(report_sql.read_tech(report_sql.tech_report(*_W3, country=COUNTRY), *_W3, 0, COUNTRY)))
