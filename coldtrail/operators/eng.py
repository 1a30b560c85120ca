"""Event detectors of the engineering report, each for all devices at once.

Every detector returns unrendered findings; :func:`coldtrail.operators.findings.render`
joins the device class once and adds the links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import CODE_PARAMETER
from ..functions.text import before_parenthesis, has_parenthesis, inside_parentheses, number_text, to_count
from ..functions.timebucket import bucket, epoch_of, slot_number, ts_lit, week_label
from ..limits import Limits
from ..sources.tables import FleetTables, between, error_rows, readings
from .edges import charge_frame, edge_power, trip_frames
from .findings import BOTH_LINKS, ERROR_LINK, eng_cases, eng_columns, eng_rows, supported
from .point_rules import BY_KEY, HIGHEST, LOWEST, Match, PointRule, point_rows
from .rollup import rollup
from .sized import MOST_ROWS, small_side

# Chart slack in seconds.
SLACK = 1200
SLACK_VOLTAGE = 600
SLACK_POWER = 7200
SLACK_OVERLAP = 12000
SLACK_CODES = 21600

# Error codes and message texts of the report.
DAQ_CODES = ("640C", "4408", "440D", "5881", "5882", "5884", "5885", "5888", "5889", "5084")
SENSOR_CODE_PREFIX = "618"
SENSOR_NAMES = {"0": "TEVIN", "1": "DAQ chain", "2": "TCDOUT"}
FAILED_START_CODE = "E0A1"
BAD_TIME = ("Bad Time ", "Help Field Techs Troubleshoot Bad Time and Using Incorrect FridgeID")
FAILED_START = ("too many failed starts", "measuredDtm of the first PCOMP signal's failed start attempt")
SOLAR_POWER = ("high compressor power (Solar Fridge)", "EWCP > 130 threshold was met")
MAINS_POWER = "high compressor power (Main Fridge)"
MAINS_EVENT_600 = "EWCP > 600 threshold was met"
MAINS_EVENT_1000 = "EWCP > 1000 threshold condtions met"
MAINS_DAY_600 = "EWCP > 600 threshold was met( 2 or more such records exists)"
MAINS_DAY_1000 = "EWCP > 1000 threshold condition was met(with 1 or more such records)."
VOLTAGE = "High voltage event"
VOLTAGE_EVENT = "measuredDtm of the first high voltage event"
VOLTAGE_DAY = "EventTime of the first high voltage event "
LOW_TEMP = "Low Temperature Alert"
LOW_TOP, LOW_BOTTOM = "excursion is TVCTOPCTL < 2", "excursion is TVCBOT < 2"
TRIP = "Mech Thermostat Engaged"
TRIP_STOP = "Event Time of thermostat trips when compressor is running"
TRIP_START = "Event Time of thermostat trips before compressor is supposed to start but doesn't"
SOLAR_STUCK = "solar compressor not running"
NO_DOOR = ("Door Openings", "No door openings over the week")
OVERLAP = ("Overlapping data/FridgeID", "More than 370 measurements in this hour")
AMBIENT_HIGH = ("TAMDAQ High Temp Alerts", "measuredDtm of the max TAMDAQ above 40C")
AMBIENT_LOW = ("TAMDAQ Low Temp Alerts", "measuredDtm of the min TAMDAQ below 10C")
CHARGE = "Low compressor power, check for low charge"
CHARGE_LOW = "2 minute average < 160 watts, low ambient"
CHARGE_LOW_EVENT = "2 minute average < 160 watts , low ambient"
CHARGE_HIGH = "2 minute average < 170 watts, high ambient"
DAQ_ERROR = "DAQ Error : "
SENSOR_ERROR = "DAQ sensor error"


def _hour_later(column: str = "EventTime") -> Column:
    return F.col(column) + F.expr("interval 1 hour")


def _day_later(column: str = "EventTime") -> Column:
    return F.col(column) + F.expr("interval 1 day")


def _one() -> Column:
    return F.lit(1)


def _point(column: str = "EventTime") -> tuple[str, str]:
    return (column, column)


def bad_time(t: FleetTables, start, end, interval: str = "Day", limits: Limits = Limits()) -> DataFrame:
    """Distinct timestamps of bad-clock errors; buckets with more than ``bad_time_min`` of them."""
    interval = supported(interval, "All", "Day", "Week")
    raw = (
        between(t.bad_time_errors, start, end, at="createddtm")
        .groupBy("fridgeid", F.col("createddtm").alias("EventTime")).agg(F.count(F.lit(1)).alias("RecCount")))
    if interval == "All":
        return eng_rows(raw, interval, *BAD_TIME, span=_point(), slack_s=SLACK)
    rolled = rollup(raw.drop("RecCount"), interval).where(F.col("RecCount") > limits.bad_time_min)
    return eng_rows(rolled, interval, *BAD_TIME, slack_s=SLACK)


def failed_starts(t: FleetTables, start, end, interval: str = "Week", limits: Limits = Limits()) -> DataFrame:
    interval = supported(interval, "All", "Day", "Week")
    raw = error_rows(t.errors, start, end, [FAILED_START_CODE]).select(
        "fridgeid", F.col("measureddtm").alias("EventTime"))
    codes = F.lit(CODE_PARAMETER + FAILED_START_CODE)
    shape = {"slack_s": SLACK, "links": ERROR_LINK, "codes": codes}
    if interval == "All":
        return eng_rows(raw, interval, *FAILED_START, count=_one(), span=("EventTime", _day_later()), **shape)
    return eng_rows(rollup(raw, interval), interval, *FAILED_START, **shape)


# --- rules over single readings, evaluated together -------------------------------------------

VOLT, LOW, AMBIENT, SOLAR, MAINS, STUCK, OVERLAPS, DOORS = range(1, 9)


def _value() -> Column:
    return number_text(F.col("value"))


def voltage_rule(interval: str, limits: Limits) -> PointRule:
    interval = supported(interval, "All", "Day")
    shape = {"value": _value(), "slack_s": SLACK_VOLTAGE}
    match = Match(F.col("EVLN") > limits.high_volt, F.col("EVLN"))
    if interval == "All":
        return PointRule(VOLT, ("EVLN",), (match,), None, lambda: eng_columns(
            interval, VOLTAGE, VOLTAGE_EVENT, count=_one(), span=("EventTime", _hour_later()), **shape))
    return PointRule(VOLT, ("EVLN",), (match,), interval, lambda: eng_columns(interval, VOLTAGE, VOLTAGE_DAY, **shape), pick=HIGHEST)


def low_temperature_rule(interval: str, limits: Limits) -> PointRule:
    """Both compartment sensors; a reading may count for each."""
    interval = supported(interval, "All", "Day")
    texts = sorted((LOW_TOP, LOW_BOTTOM))
    matches = tuple(
        Match(F.col(column) < limits.low_temp_c, F.col(column), detail=texts.index(text))
        for column, text in (("TVCTOPCTL", LOW_TOP), ("TVCBOT", LOW_BOTTOM)))
    detail = F.when(F.col("detail") == 0, texts[0]).otherwise(texts[1])
    shape = {"value": _value(), "slack_s": SLACK}
    if interval == "All":
        return PointRule(LOW, ("TVCTOPCTL", "TVCBOT"), matches, None, lambda: eng_columns(
            interval, LOW_TEMP, detail, count=_one(), span=("EventTime", _hour_later()), **shape))
    return PointRule(LOW, ("TVCTOPCTL", "TVCBOT"), matches, interval, lambda: eng_columns(interval, LOW_TEMP, detail, **shape), pick=LOWEST)


def ambient_rule(interval: str, limits: Limits) -> PointRule:
    """The week's hottest and coldest excursion of a device."""
    interval = supported(interval, "All", "Week")
    ambient = F.col("TAMDAQ")
    low = ambient < limits.ambient_low_c
    match = Match(low | (ambient > limits.ambient_high_c), ambient, key=low)
    texts = [F.when(F.col("key") == 1, a).otherwise(b) for a, b in zip(AMBIENT_LOW, AMBIENT_HIGH)]
    shape = {"value": _value(), "slack_s": SLACK}
    if interval == "All":
        return PointRule(AMBIENT, ("TAMDAQ",), (match,), None, lambda: eng_columns(interval, *texts, count=_one(), span=_point(), **shape))
    return PointRule(AMBIENT, ("TAMDAQ",), (match,), interval, lambda: eng_columns(interval, *texts, **shape), pick=BY_KEY)


def solar_power_rule(interval: str, limits: Limits) -> PointRule:
    """The chart of a day runs from the lowest-valued to the highest-valued event."""
    interval = supported(interval, "All", "Day")
    match = Match(F.col("EWCP") > limits.solar_power_w, F.col("EWCP"))
    shape = {"value": _value(), "slack_s": SLACK_POWER, "only": "S"}
    if interval == "All":
        return PointRule(SOLAR, ("EWCP",), (match,), None, lambda: eng_columns(
            interval, *SOLAR_POWER, count=_one(), span=("EventTime", _hour_later()), **shape), solar=True)
    return PointRule(SOLAR, ("EWCP",), (match,), interval, lambda: eng_columns(
        interval, *SOLAR_POWER, span=("LowTime", "EventTime"), **shape), pick=HIGHEST, both_ends=True, solar=True)


def mains_power_rule(interval: str, limits: Limits) -> PointRule:
    """Days with enough readings above the first threshold or one above the second."""
    interval = supported(interval, "All", "Day")
    power = F.col("value")
    match = Match(F.col("EWCP2") > limits.mains_power_w, F.col("EWCP2"))
    above_low, above_high = power < limits.mains_power_high_w, power > limits.mains_power_high_w
    shape = {"value": _value(), "slack_s": SLACK_POWER, "only": "M"}
    if interval == "All":
        detail = F.when(above_low, MAINS_EVENT_600).when(above_high, MAINS_EVENT_1000)
        return PointRule(MAINS, ("EWCP2",), (match,), None, lambda: eng_columns(
            interval, MAINS_POWER, detail, count=_one(), span=("EventTime", _hour_later()), **shape))
    often, once = F.col("low_count") >= limits.mains_power_min_count, F.col("high_count") >= 1
    return PointRule(MAINS, ("EWCP2",), (match,), interval, lambda: eng_columns(
        interval, MAINS_POWER, F.when(often, MAINS_DAY_600).otherwise(MAINS_DAY_1000),
        count=F.when(often, F.col("low_count")).otherwise(F.col("high_count")), span=("LowTime", "EventTime"), **shape),
        pick=HIGHEST, both_ends=True, counted=(above_low, above_high), keep=often | once)


def stuck_rule(interval: str, limits: Limits) -> PointRule:
    """Solar compressors that do not run although they could: days with enough readings, or weeks with enough full hours."""
    interval = supported(interval, "All", "Day", "Week")
    columns = ("SCPS", "ICPS", "EWDCA", "SLNX")
    match = Match((F.col("SCPS") == limits.stuck_scps) & (F.col("ICPS") == limits.stuck_icps) & (
        (F.col("EWDCA") > limits.stuck_pv_w) | (F.col("SLNX") == 1)))
    shape = {"slack_s": SLACK, "only": "S"}
    if interval == "All":
        return PointRule(STUCK, columns, (match,), None, lambda: eng_columns(
            interval, SOLAR_STUCK, TRIP_STOP, count=_one(), span=_point(), **shape), solar=True)
    if interval == "Day":
        return PointRule(STUCK, columns, (match,), "Day", lambda: eng_columns(interval, SOLAR_STUCK, TRIP_STOP, **shape),
                         keep=F.col("RecCount") > limits.stuck_day_min, solar=True)
    return PointRule(STUCK, columns, (match,), "Hour", lambda: eng_columns(interval, SOLAR_STUCK, TRIP_STOP, at="FirstTime", **shape),
                     keep=F.col("full") >= limits.stuck_hours, weekly=True, full=F.col("RecCount") > limits.stuck_hour_min, solar=True)


def overlap_rule(interval: str, limits: Limits, doors: bool = False) -> PointRule:
    """Readings by hour; with ``doors`` their door openings are summed up by device as well."""
    interval = supported(interval, "All", "Hour")
    hour = ("bucket", "bucket")
    found = F.lit(True) if interval == "All" else F.col("RecCount") >= limits.overlap_per_hour
    return PointRule(OVERLAPS, ("SDXC",) if doors else (), (Match(F.lit(True), F.col("SDXC") if doors else None),), "Hour", lambda: eng_columns(
        interval, OVERLAP[0], None if interval == "All" else OVERLAP[1], at="bucket", span=hour, slack_s=SLACK_OVERLAP),
        keep=found, per_device=(DOORS,) if doors else ())


def door_rule(start, end) -> PointRule:
    """Devices whose readings count no opening; without a scan of its own, see ``overlap_rule``."""
    return PointRule(DOORS, (), (), "Week", lambda: eng_columns(
        "Week", *NO_DOOR, count="total", at="last_time", span=(ts_lit(start), ts_lit(end)), slack_s=SLACK), keep=F.col("total") == 0)


def point_findings(t: FleetTables, start, end, interval: str = "Day", limits: Limits = Limits()) -> DataFrame:
    """All rules of the report over single readings, from one scan of the window and one of the door openings before it."""
    rules = [
        voltage_rule(interval, limits), low_temperature_rule(interval, limits), ambient_rule("Week", limits), solar_power_rule(interval, limits),
        mains_power_rule(interval, limits), stuck_rule("Week", limits), overlap_rule("Hour", limits, doors=True), door_rule(start, end)]
    opened = last_door_opening(t, start, limits).withColumn("rule", F.lit(DOORS))
    return point_rows(t, start, end, rules, opened)


def solar_power(t: FleetTables, start, end, interval: str = "Day", limits: Limits = Limits()) -> DataFrame:
    return point_rows(t, start, end, [solar_power_rule(interval, limits)])


def mains_power(t: FleetTables, start, end, interval: str = "Day", limits: Limits = Limits()) -> DataFrame:
    return point_rows(t, start, end, [mains_power_rule(interval, limits)])


def high_compressor_power(t: FleetTables, start, end, interval: str = "Day", limits: Limits = Limits()) -> DataFrame:
    return point_rows(t, start, end, [solar_power_rule(interval, limits), mains_power_rule(interval, limits)])


def high_voltage(t: FleetTables, start, end, interval: str = "Day", limits: Limits = Limits()) -> DataFrame:
    return point_rows(t, start, end, [voltage_rule(interval, limits)])


def low_temperature(t: FleetTables, start, end, interval: str = "Day", limits: Limits = Limits()) -> DataFrame:
    return point_rows(t, start, end, [low_temperature_rule(interval, limits)])


def ambient_extremes(t: FleetTables, start, end, interval: str = "Week", limits: Limits = Limits()) -> DataFrame:
    return point_rows(t, start, end, [ambient_rule(interval, limits)])


def overlapping_data(t: FleetTables, start, end, interval: str = "Hour", limits: Limits = Limits()) -> DataFrame:
    return point_rows(t, start, end, [overlap_rule(interval, limits)])


def no_door_openings(t: FleetTables, start, end, interval: str = "Week", limits: Limits = Limits()) -> DataFrame:
    """Devices with readings but no opening in the window; the event is the last opening of the weeks before.

    Two phases: the window's openings by device, then a look-back that reads openings
    only, of the devices without one in the window.
    """
    interval = supported(interval, "Week")
    totals = readings(t.sensor, start, end, "SDXC").groupBy("fridgeid").agg(F.sum("SDXC").alias("total"))
    closed = totals.where("total = 0")
    before = between(t.sensor, start, start, back_s=limits.door_lookback_days * 86400).where("SDXC > 0")
    before = before.join(small_side(closed.select("fridgeid")), "fridgeid", "left_semi")
    found = closed.join(before.groupBy("fridgeid").agg(F.max("measureddtm").alias("last_time")), "fridgeid", "left")
    return eng_rows(found, interval, *NO_DOOR, count="total", at="last_time", span=(ts_lit(start), ts_lit(end)), slack_s=SLACK)


def last_door_opening(t: FleetTables, before, limits: Limits = Limits()) -> DataFrame:
    """Last opening of each device in the look-back days before a time."""
    rows = between(t.sensor, before, before, back_s=limits.door_lookback_days * 86400)
    return rows.where("SDXC > 0").groupBy("fridgeid").agg(F.max("measureddtm").alias("last_time"))


# --- thermostat and charge: edges ------------------------------------------------------------


def trip_events(edges: DataFrame, limits: Limits) -> DataFrame:
    return edges.where(F.col("name").isin("stop_trip", "start_trip") & (F.col("avg_w") < limits.trip_max_w)).select(
        "fridgeid", "EventTime", F.when(F.col("name") == "stop_trip", TRIP_STOP).otherwise(TRIP_START).alias("Detail"))


def solar_trips(t: FleetTables, start, end, interval: str = "Week", limits: Limits = Limits()) -> DataFrame:
    return point_rows(t, start, end, [stuck_rule(interval, limits)])


def mains_trips(events: DataFrame, interval: str = "Week") -> DataFrame:
    """Roll-up of :func:`trip_events`."""
    interval = supported(interval, "All", "Day", "Week")
    shape = {"slack_s": SLACK, "only": "M"}
    if interval == "All":
        return eng_rows(events, interval, TRIP, F.col("Detail"), count=_one(), span=_point(), **shape)
    by_detail = rollup(events, interval, keys=("Detail",)).drop("EventTime")
    if interval == "Day":
        # the day's first event names the Detail and its count; the chart ends at the day's last event
        days = by_detail.groupBy("fridgeid", "bucket").agg(
            F.min(F.struct("FirstTime", "Detail", "RecCount")).alias("first"), F.max("LastTime").alias("LastTime"))
        days = days.select("fridgeid", "LastTime", "first.*")
        return eng_rows(days, interval, TRIP, F.col("Detail"), at="FirstTime", **shape)
    # each Detail's first event is charted up to the last event of every Detail of the week: at most 2 x 2 rows
    week = Window.partitionBy("fridgeid", "bucket")
    ends = by_detail.withColumn("ends", F.collect_list("LastTime").over(week))
    paired = ends.select("fridgeid", "Detail", "RecCount", "FirstTime", F.explode("ends").alias("LastTime"))
    return eng_rows(paired, interval, TRIP, F.col("Detail"), at="FirstTime", **shape)


def mech_thermostat(t: FleetTables, start, end, interval: str = "Week", limits: Limits = Limits(),
                    edges: DataFrame | None = None) -> DataFrame:
    if edges is None:
        edges = edge_power(t.sensor, start, end, trip_frames(limits))
    return solar_trips(t, start, end, interval, limits).unionByName(
        mains_trips(trip_events(edges, limits), interval))


def _charge_bands(power: Column, ambient: Column, limits: Limits) -> tuple[Column, Column]:
    low = (power >= limits.charge_floor_w) & (power < limits.charge_low_w) & (ambient < limits.charge_ambient_c)
    return low, (power >= limits.charge_low_w) & (power < limits.charge_high_w) & (ambient >= limits.charge_ambient_c)


def low_charge(t: FleetTables, start, end, interval: str = "Day", limits: Limits = Limits(),
               edges: DataFrame | None = None) -> DataFrame:
    """Low power in the minutes before shutdown, in a band that depends on the ambient temperature."""
    interval = supported(interval, "All", "Day", "Week")
    if edges is None:
        edges = edge_power(t.sensor, start, end, [charge_frame(limits)])
    power, ambient = F.col("avg_w"), F.col("avg_ambient")
    low, high = _charge_bands(power, ambient, limits)
    raw = edges.where((F.col("name") == "charge") & (F.col("samples") > limits.charge_min_count) & (low | high)).select(
        "fridgeid", "EventTime", power.alias("value"), "samples", (power < limits.charge_low_w).alias("is_low"))
    is_low = F.col("is_low")
    shape = {"value": number_text(F.col("value")), "slack_s": SLACK, "only": "M"}
    if interval == "All":
        return eng_rows(raw, interval, CHARGE, F.when(is_low, CHARGE_LOW_EVENT).otherwise(CHARGE_HIGH), count="samples",
                        span=("EventTime", F.when(is_low, _hour_later()).otherwise(F.col("EventTime"))), **shape)
    rolled = rollup(raw, interval, keys=("is_low",), carry=("value",))
    return eng_rows(rolled, interval, CHARGE, F.when(is_low, CHARGE_LOW).otherwise(CHARGE_HIGH), **shape)


TRIPS, CHARGES = 1, 2


def edge_findings(edges: DataFrame, interval: str = "Day", limits: Limits = Limits()) -> DataFrame:
    """Weekly thermostat trips and low charge of one edge table, rolled up together so that its readings are read once."""
    interval = supported(interval, "All", "Day", "Week")
    at, power, ambient = F.col("EventTime"), F.col("avg_w"), F.col("avg_ambient")
    trip = F.col("name").isin("stop_trip", "start_trip") & (power < limits.trip_max_w)
    low, high = _charge_bands(power, ambient, limits)
    charge = (F.col("name") == "charge") & (F.col("samples") > limits.charge_min_count) & (low | high)
    texts = sorted((TRIP_STOP, TRIP_START))
    # edges of one kind and second are one row, so an event is a bucket of its own
    own = at if interval == "All" else bucket(at, interval).cast("timestamp")
    rows = edges.where(trip | charge).select(
        "fridgeid", "EventTime", "samples", power.alias("value"), F.when(trip, TRIPS).otherwise(CHARGES).alias("rule"),
        F.when(trip, (F.col("name") == "stop_trip").cast("int") * texts.index(TRIP_STOP) + (F.col("name") == "start_trip").cast("int") * texts.index(TRIP_START)).otherwise(
            (power < limits.charge_low_w).cast("int")).alias("key"),
        F.when(trip, bucket(at, "Week").cast("timestamp")).otherwise(own).alias("bucket"))
    rolled = rows.groupBy("fridgeid", "rule", "key", "bucket").agg(
        F.count(F.lit(1)).alias("RecCount"), F.sum("samples").alias("samples"), F.min("EventTime").alias("EventTime"), F.max("EventTime").alias("LastTime"), F.min_by("value", "EventTime").alias("value"))
    # each Detail's first trip is charted up to the last trip of every Detail of the week: at most 2 x 2 rows
    week = Window.partitionBy("fridgeid", "rule", "bucket")
    ends = F.when(F.col("rule") == TRIPS, F.collect_list("LastTime").over(week)).otherwise(F.array("LastTime"))
    paired = rolled.withColumn("ends", ends).select("fridgeid", "rule", "key", "RecCount", "samples", "EventTime", "value", F.explode("ends").alias("LastTime"))
    is_low = F.col("key") == 1
    shape = {"slack_s": SLACK, "only": "M"}
    if interval == "All":
        charged = eng_columns(interval, CHARGE, F.when(is_low, CHARGE_LOW_EVENT).otherwise(CHARGE_HIGH), value=_value(), count="samples",
                              span=("EventTime", F.when(is_low, _hour_later()).otherwise(at)), **shape)
    else:
        charged = eng_columns(interval, CHARGE, F.when(is_low, CHARGE_LOW).otherwise(CHARGE_HIGH), value=_value(), span=("EventTime", "LastTime"), **shape)
    trips = eng_columns("Week", TRIP, F.when(F.col("key") == 0, texts[0]).otherwise(texts[1]), span=("EventTime", "LastTime"), **shape)
    return eng_cases(paired, [(F.col("rule") == TRIPS, trips), (F.col("rule") == CHARGES, charged)])


# --- error codes -----------------------------------------------------------------------------


def _daq_rows(t: FleetTables, start, end) -> DataFrame:
    rows = error_rows(t.errors, start, end, DAQ_CODES)
    counted = has_parenthesis(F.col("message"))
    uncounted = (F.col("id") == "5884") & (F.col("message") == "")
    return rows.where(counted | uncounted).select(
        "fridgeid", "id", F.col("measureddtm").alias("EventTime"), F.col("description").alias("Detail"),
        F.when(counted, inside_parentheses(F.col("message"))).otherwise("1").alias("value"))


#: Code, column, extreme and further condition of the sensor values beside a code.
CODE_EXTREMES = {
    "v5881": ("5881", "EWCP2", F.max, "SCPX = 1"), "v5882_on": ("5882", "EWCP2", F.min, "SCPX = 1 and EWCP2 > 1"), "v5882_any": ("5882", "EWCP2", F.min, "SCPX = 1"),
    "v5888": ("5888", "TCPDISCTL", F.max, "true"), "v5889": ("5889", "TEVIN", F.min, "SCPX = 1"), "v5084_max": ("5084", "ECDBAT", F.max, "SCPX = 1"),
    "v5084_min": ("5084", "ECDBAT", F.min, "SCPX = 1"),
}


def hour_extremes(readings: DataFrame, borders: DataFrame) -> DataFrame:
    """Extremes of ``CODE_EXTREMES`` by device and hour; in the hours of ``borders`` (fridgeid, hour) by single time.

    ``since`` is the time of the group, or the begin of its hour. The summaries
    combine in the map tasks, so only they are shuffled.
    """
    marked = readings.join(borders.withColumn("border", F.lit(True)), ["fridgeid", "hour"], "left")
    single = F.when(F.col("border"), F.col("measureddtm"))
    grouped = marked.groupBy("fridgeid", "hour", single.alias("single")).agg(*[
        extreme(F.when(F.expr(condition), F.col(column))).alias(name) for name, (_, column, extreme, condition) in CODE_EXTREMES.items()])
    return grouped.withColumn("since", F.coalesce("single", F.timestamp_seconds(F.col("hour") * 3600)))


def code_values(events: DataFrame, sensor: DataFrame, start, end, limits: Limits = Limits(), most: int = MOST_ROWS) -> DataFrame:
    """Sensor extremes of each code in the days after its first event.

    ``events`` has one row per device and code, so a device is one row of five
    times. As long as the devices can be broadcast (at most ``most``), readings meet
    them in the map tasks and leave as one row of extremes. Beyond that they are
    summed up by (device, hour): an hour lies inside or outside a code's days as a
    whole, but for the two hours at its borders, where each time stays by itself.
    """
    valued = ("5881", "5882", "5888", "5889", "5084")
    first = events.where(F.col("id").isin(*valued)).groupBy("fridgeid").agg(
        *[F.min(F.when(F.col("id") == c, F.col("EventTime"))).alias(f"at_{c}") for c in valued])
    few = first.limit(most + 1).count() <= most
    span = F.expr(f"interval {limits.code_value_days} days")
    times = F.array_compact(F.array(*[f"at_{c}" for c in valued]))
    edges = F.concat(times, F.transform(times, lambda x: x + span))
    borders = first.select("fridgeid", F.explode(F.array_distinct(F.transform(edges, lambda x: slot_number(x, 3600)))).alias("hour"))
    measured = between(sensor, start, end, fwd_s=limits.code_value_days * 86400).select(
        "fridgeid", "measureddtm", slot_number(F.col("measureddtm"), 3600).alias("hour"), "SCPX", "EWCP2", "TEVIN", "TCPDISCTL", "ECDBAT")
    def of_days(since: str, code: str, value: Column) -> Column:
        at = F.col(f"at_{code}")
        return F.when((F.col(since) >= at) & (F.col(since) < at + span), value)

    if few:
        known = measured.join(F.broadcast(first.select("fridgeid")), "fridgeid", "left_semi")
        groups = known.join(F.broadcast(first), "fridgeid")
        values = {name: of_days("measureddtm", code, F.when(F.expr(condition), F.col(column)))
                  for name, (code, column, _, condition) in CODE_EXTREMES.items()}
    else:
        groups = hour_extremes(measured, borders).join(first, "fridgeid")
        values = {name: of_days("since", code, F.col(name)) for name, (code, *_) in CODE_EXTREMES.items()}
    met = groups.groupBy("fridgeid").agg(*[CODE_EXTREMES[name][2](value).alias(name) for name, value in values.items()])
    battery = F.concat(F.lit("["), number_text(F.col("v5084_max")), F.lit(","), number_text(F.col("v5084_min")), F.lit("]"))
    texts = {
        "5881": number_text(F.col("v5881")), "5882": number_text(F.coalesce("v5882_on", "v5882_any")),
        "5888": number_text(F.col("v5888")), "5889": number_text(F.col("v5889")), "5084": battery,
    }
    return met.select("fridgeid", F.inline(F.array(*[
        F.struct(F.lit(code).alias("id"), text.alias("code_value")) for code, text in texts.items()])))


def daq_codes(t: FleetTables, start, end, interval: str = "Week", limits: Limits = Limits()) -> DataFrame:
    """One finding per code, if its first and last event fall in the same week."""
    interval = supported(interval, "All", "Week")
    raw = _daq_rows(t, start, end)
    message = F.concat(F.lit(DAQ_ERROR), F.col("id"))
    shape = {"slack_s": SLACK_CODES, "links": BOTH_LINKS, "codes": F.concat(F.lit(CODE_PARAMETER), F.col("id"))}
    if interval == "All":
        return eng_rows(raw, interval, message, F.col("Detail"), value=F.col("value"), count=_one(),
                        span=("EventTime", _day_later()), **shape)
    rolled = rollup(raw, None, keys=("id",), carry=("Detail",), extra={"total": F.sum(to_count(F.col("value")))})
    rolled = rolled.where(week_label(F.col("FirstTime")) == week_label(F.col("LastTime")))
    valued = rolled.join(code_values(rolled, t.sensor, start, end, limits), ["fridgeid", "id"], "left")
    value = F.when(F.col("id") == "5884", F.col("total").cast("string")).otherwise(F.col("code_value"))
    return eng_rows(valued, interval, message, F.col("Detail"), value=value, **shape)


def _listed_codes(raw: DataFrame) -> DataFrame:
    """(fridgeid, RecCount of the window, ids, sensors): distinct rows first, then one sorted list of few texts per device."""
    distinct = raw.groupBy("fridgeid", "id", "sensor").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("fridgeid").agg(
        F.sum("n").cast("int").alias("total"), F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set("sensor")).alias("sensors"))


def daq_sensor_codes(t: FleetTables, start, end, interval: str = "Week", limits: Limits = Limits()) -> DataFrame:
    """Sensor codes: one weekly row listing all codes and sensors of the device's window."""
    interval = supported(interval, "All", "Week")
    rows = error_rows(t.errors, start, end).where(
        F.col("id").startswith(SENSOR_CODE_PREFIX) & has_parenthesis(F.col("message")))
    code = before_parenthesis(F.col("message"))
    names = F.create_map(*[F.lit(x) for pair in SENSOR_NAMES.items() for x in pair])
    name = F.coalesce(F.try_element_at(names, code), code)
    raw = rows.select("fridgeid", "id", name.alias("sensor"), F.col("measureddtm").alias("EventTime"))
    shape = {"slack_s": SLACK_CODES, "links": BOTH_LINKS}
    if interval == "All":
        return eng_rows(raw, interval, F.col("id"), F.col("sensor"), count=_one(), span=("EventTime", _day_later()),
                        codes=F.concat(F.lit(CODE_PARAMETER), F.col("id")), **shape)
    weeks = rollup(raw, "Week").drop("bucket", "EventTime")
    listed = _listed_codes(raw).join(weeks.drop("RecCount"), "fridgeid").withColumns({"EventTime": F.col("FirstTime"), "RecCount": F.col("total")})
    codes = F.concat(F.lit(CODE_PARAMETER), F.array_join("ids", CODE_PARAMETER))
    return eng_rows(listed, interval, SENSOR_ERROR, F.array_join("ids", ","), value=F.array_join("sensors", ","),
                    codes=codes, **shape)


def daq_errors(t: FleetTables, start, end, interval: str = "Week", limits: Limits = Limits()) -> DataFrame:
    return daq_codes(t, start, end, interval, limits).unionByName(daq_sensor_codes(t, start, end, interval, limits))
