"""Derived fleet tables as CTEs, and SQL fragments used by several statements."""

from __future__ import annotations

import datetime as dt

from .settings import END, START
from .values import BASE, CODE_PARAMETER

TABLES = """
with raw as (
  select user_id as fridgeid, date_trunc('second', ts + interval 500 millisecond) as measureddtm, event_id, event_type, value,
         cast(regexp_extract(props, '"k": *([0-9]+)', 1) as int) as k
  from events),
sensor as (
  select fridgeid, measureddtm, event_id,
    cast(case when event_id % 11 = 0 then null else value * 4 end as double) as EVLN,
    cast(k as double) * 0.3::double + 40 as EHZLN,
    cast(case when event_id % 5 = 0 then 0.5 else value * 12 end as double) as EWCP2,
    cast(value * 2 as double) as EWCP, cast(value as double) as EWDCA,
    case when event_id % 6 = 0 then null else value / 10 end as TVCTOPCTL, cast(k as double) / 10 as TVCBOT,
    case when event_id % 9 = 0 then null else cast(k as double) * 0.5::double - 2 end as TAMDAQ,
    case when event_id % 8 = 0 then null else cast(k as double) * 0.1::double end as TICMCTL,
    case when event_id % 10 = 0 then null else cast(k as double) * 0.2::double end as TICBKCTL,
    case when event_id % 4 = 1 then null else cast(k as double) * 1.5::double end as CTBH,
    cast(k as double) / 100 as EVDBAT, cast(k as double) / 10 as ECDBAT, value - 20 as TEVIN, value + 20 as TCPDISCTL,
    case event_type when 'click' then 1 when 'view' then 0 when 'purchase' then 6 when 'signup' then 2 end as SCPX,
    case when event_id % 7 = 0 then 2000 else 1000 end as SCPS, k % 3 as ICPS,
    case when event_id % 4 = 0 then null else k % 2 end as SLNX,
    case when event_type = 'signup' and event_id % 3 = 0 then 1 else 0 end as SDXC
  from raw),
errors as (
  select fridgeid, measureddtm, id, 'error ' || id as description,
    case when event_id % 20 = 5 and event_id % 3 = 0 then ''
         else (event_id % 3) || '(' || cast(floor(value) as int) || ')' end as message
  from (select *, (['640C','4408','440D','5881','5882','5884','5885','5888','5889','5084','6181','618B','E0A1','4406',
                    '6402','5404','6782','6784','6301','630D'])[event_id % 20 + 1] as id
        from raw where event_type = 'error')),
bad_time_errors as (select fridgeid, measureddtm as createddtm from raw where event_type = 'signup'),
users as (select distinct fridgeid from raw),
device as (select c_custkey as fridgeid, c_name as FridgeShortSN from customer where c_custkey in (select fridgeid from users)),
device_group as (
  select fridgeid, 'solar' as GroupName from users where fridgeid % 3 = 0
  union all select fridgeid, 'freezer' from users where fridgeid % 17 = 0),
location_history as (
  select o_custkey as fridgeid, o_orderdate as createddtm, o_orderkey as location_id, n_name as country, r_name as L1,
         o_orderpriority as L3, cast(o_orderdate as date) as commDte, case o_orderstatus when 'F' then 1 else 0 end as report
  from orders left join nation on o_orderkey % 25 = n_nationkey left join region on n_regionkey = r_regionkey
  where o_custkey in (select fridgeid from users))"""

SOLAR = "(select fridgeid from device_group where GroupName = 'solar')"
FREEZER = "(select fridgeid from device_group where GroupName = 'freezer')"


def window(column: str = "measureddtm", start: str = START, end: str = END) -> str:
    return f"{column} >= timestamp '{start}' and {column} < timestamp '{end}'"


def week(column: str) -> str:
    return f"(date_trunc('week', {column} + interval 1 day) + interval 4 day)"


def bucket(interval: str, column: str = "EventTime") -> str:
    return week(column) if interval == "Week" else f"date_trunc('{interval.lower()}', {column})"


def number(column: str) -> str:
    return f"case when {column} is not null then printf('%.6g', {column}) end"


def slot(column: str, seconds: int) -> str:
    return f"cast(floor(epoch({column}) / {seconds}) as bigint)"


def _span(page: str, start: str, end: str, slack: int | str) -> str:
    return (f"{page} || fridgeid || '&start=' || (cast(epoch({start}) as bigint) - {slack})"
            f" || '&stop=' || (cast(epoch({end}) as bigint) + {slack})")


def device_link(start: str, end: str, slack: int) -> str:
    page = f"(case when fridgeid in {SOLAR} then '{BASE.device_solar}' else '{BASE.device_mains}' end)"
    return _span(page, start, end, slack)


def error_link(start: str, end: str, slack: int, codes: str) -> str:
    page = f"(case when fridgeid in {SOLAR} then '{BASE.errors_solar}' else '{BASE.errors_mains}' end)"
    return f"{_span(page, start, end, slack)} || {codes}"


def code(column: str = "id") -> str:
    return f"'{CODE_PARAMETER}' || {column}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def finding(interval: str, message: str, detail: str, value: str, count: str, at: str, link: str, source: str,
            glink: str = "null") -> str:
    """Engineering finding; all arguments are SQL."""
    return (f"select fridgeid, '{interval}' as MessageInterval, {message} as Message, cast({detail} as varchar) as Detail, "
            f"cast({value} as varchar) as value, cast({count} as int) as RecCount, cast({at} as timestamp) as EventTime, "
            f"{link} as link, cast({glink} as varchar) as Glink from {source}")


def rolled(raw: str, interval: str, worst: str | None = None, keys: str = "") -> str:
    """Self-joins of first, last, worst and count rows of each device and bucket."""
    part = f"fridgeid, b{', ' + keys if keys else ''}"
    worst = worst or "EventTime"
    numbered = (f"(select *, row_number() over (partition by {part} order by {worst}) as r_worst, "
                f"row_number() over (partition by {part} order by EventTime) as r_min, "
                f"row_number() over (partition by {part} order by EventTime desc) as r_max "
                f"from (select *, {bucket(interval)} as b from {raw}))")
    return (f"(select w.*, f.EventTime as first_time, l.EventTime as last_time, c.n "
            f"from (select * from {numbered} where r_worst = 1) w "
            f"join (select * from {numbered} where r_min = 1) f using ({part}) "
            f"join (select * from {numbered} where r_max = 1) l using ({part}) "
            f"join (select {part}, count(*) as n from {numbered} group by {part}) c using ({part}))")


def query(body: str) -> str:
    """A complete statement: ``body`` is ``name as (...), ... select ...`` after the derived tables."""
    return f"{TABLES},\n{body}"


def _whole(value: str, seconds: int) -> int:
    """Units of so many seconds begun since 1970."""
    return int((dt.datetime.fromisoformat(value) - dt.datetime(1970, 1, 1)).total_seconds()) // seconds


def window_days(start: str, end: str) -> int:
    return _whole(end, 86400) - _whole(start, 86400)


def window_minutes(start: str, end: str) -> int:
    return _whole(end, 60) - _whole(start, 60)
