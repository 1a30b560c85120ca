"""The one-pass report: packed order keys, scans of the sensor series, state of last readings."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from compare import explained
from coldtrail.functions.orderkey import detail_of, packed, time_of, value_of
from coldtrail.limits import Limits
from coldtrail.operators import eng
from coldtrail.operators.findings import render
from coldtrail.operators.sized import small_side
from coldtrail.plans import jobs
from coldtrail.plans.eng_report import eng_report
from coldtrail.plans.last_seen import last_seen
from coldtrail.plans.tech_report import tech_report
from coldtrail.sources import sinks
from coldtrail.sources.events_adapter import fleet_from_events
from coldtrail.sources.tables import FleetTables
from oracle.settings import END, EXCLUDED, LIMITS, RUN_TIME, START
from test_reports import world  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fleet(spark):
    return fleet_from_events(spark, FOLDER)


def test_packed_keys_order_like_their_parts_and_give_them_back(spark):
    rnd = random.Random(3)
    values = [0.0, -0.0, 1e-300, -1e-300, 350.1, math.nextafter(350.1, 400), -17.25, 1e18, -1e18, math.inf, -math.inf] + [rnd.uniform(-500, 500) for _ in range(60)]
    times = [dt.datetime(2024, 1, 1, 0, 0, 0, k) for k in range(3)] + [dt.datetime(1970, 1, 1), dt.datetime(2200, 5, 5)]
    rows = [(v, rnd.choice(times), rnd.randrange(4)) for v in values for _ in range(3)]
    frame = spark.createDataFrame(rows, "v double, t timestamp, d int").withColumn("key", packed(F.col("v"), F.col("t"), F.col("d")))
    got = frame.orderBy("key", "v").select("v", "t", "d", value_of(F.col("key")), time_of(F.col("key")), detail_of(F.col("key"))).collect()
    assert [(r[0] + 0.0, r[1], r[2]) for r in got] == sorted((v + 0.0, t, d) for v, t, d in rows)
    assert [tuple(r[:3]) for r in got] == [tuple(r[3:]) for r in got]
    none = spark.createDataFrame([(None,)], "v double").select(value_of(packed(F.col("v"), F.lit(dt.datetime(2024, 1, 1))))).first()
    assert none[0] is None


@pytest.mark.parametrize("build", [eng.high_voltage, eng.low_temperature, eng.ambient_extremes, eng.solar_power, eng.mains_power, eng.overlapping_data, eng.solar_trips])
def test_extremes_aggregate_by_hash(fleet, build):
    plan = explained(build(fleet, START, END, limits=LIMITS))
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_eng_report_reads_the_sensor_series_four_times(fleet):
    plan = explained(eng_report(fleet, START, END, run_time=RUN_TIME, limits=LIMITS, excluded=EXCLUDED))
    blocks = [b for b in re.split(r"\n\n(?=\(\d+\))", plan) if "Scan parquet" in b and "events.parquet" in b]
    series = [b for b in blocks if "EqualTo(event_type,error)" not in b and not re.search(r"ReadSchema: struct<user_id:bigint>", b)]
    assert len(series) <= 4, len(series)


@pytest.mark.parametrize("interval", ["Day", "All"])
def test_rules_together_equal_rules_alone(fleet, interval):
    """Also where solar devices have a table of their own."""
    apart = FleetTables(**{n: getattr(fleet, n) for n in ("sensor", "errors", "bad_time_errors", "location_history", "device", "device_group")},
                        sensor_solar=fleet.sensor.where("fridgeid % 3 = 0"))
    for t in (fleet, apart):
        alone = [eng.high_voltage(t, START, END, interval, LIMITS), eng.low_temperature(t, START, END, interval, LIMITS), eng.ambient_extremes(t, START, END, "Week", LIMITS),
                 eng.high_compressor_power(t, START, END, interval, LIMITS), eng.solar_trips(t, START, END, "Week", LIMITS), eng.overlapping_data(t, START, END, "Hour", LIMITS),
                 eng.no_door_openings(t, START, END, "Week", LIMITS)]
        want = sorted(repr(tuple(r)) for frame in alone for r in frame.collect())
        together = eng.point_findings(t, START, END, interval, LIMITS).select(*alone[0].columns)
        assert len(want) > 100 and sorted(repr(tuple(r)) for r in together.collect()) == want


@pytest.mark.parametrize("interval", ["Day", "All", "Week"])
def test_edges_together_equal_edges_alone(fleet, interval):
    from coldtrail.operators.edges import charge_frame, edge_power, trip_frames

    edges = edge_power(fleet.sensor, START, END, [*trip_frames(LIMITS), charge_frame(LIMITS)])
    alone = [eng.mains_trips(eng.trip_events(edges, LIMITS), "Week"), eng.low_charge(fleet, START, END, interval, LIMITS, edges)]
    want = sorted(repr(tuple(r)) for frame in alone for r in frame.collect())
    together = eng.edge_findings(edges, interval, LIMITS).select(*alone[0].columns)
    assert want and sorted(repr(tuple(r)) for r in together.collect()) == want


@pytest.mark.parametrize("build", [
    lambda t: eng.high_voltage(t, START, END, "Day", LIMITS), lambda t: eng.daq_errors(t, START, END, "Week", LIMITS), lambda t: eng.bad_time(t, START, END, "Day", LIMITS),
    lambda t: eng.mech_thermostat(t, START, END, "Week", LIMITS)], ids=["voltage", "codes", "clock", "edges"])
def test_bounds_on_a_derived_time_reach_the_scan(fleet, build):
    plan = explained(build(fleet))
    blocks = [b for b in re.split(r"\n\n(?=\(\d+\))", plan) if "Scan parquet" in b and "events.parquet" in b and not re.search(r"ReadSchema: struct<user_id:bigint>", b)]
    assert blocks and all("GreaterThanOrEqual(ts," in b and "LessThan(ts," in b for b in blocks)


def test_a_frame_is_the_difference_of_two_running_sums(spark):
    from coldtrail.operators.edges import charge_frame, edge_power, trip_frames

    rnd = random.Random(12)
    limits = replace(Limits(), trip_near_s=5, trip_far_s=20, charge_settle_s=7, charge_window_s=15)
    base = dt.datetime(2024, 1, 7)
    rows = []
    for device in (1, 2):
        for k, second in enumerate(sorted(rnd.sample(range(4000), 900))):  # every few seconds, across chunk borders
            rows.append((device, base + dt.timedelta(seconds=second), k, rnd.choice([0, 1, 1, 6]), rnd.choice([None, 0.0, 0.1, 1.0, 159.999999, 160.0]), rnd.choice([None, 29.9, 30.0])))
    sensor = spark.createDataFrame(rows, "fridgeid long, measureddtm timestamp, reading_id long, SCPX int, EWCP2 double, TAMDAQ double")
    frames = [*trip_frames(limits), charge_frame(limits)]
    got = {(r["fridgeid"], r["name"], r["EventTime"]): (r["samples"], r["avg_w"], r["avg_ambient"]) for r in edge_power(sensor, base, base + dt.timedelta(hours=1), frames).collect()}
    want = {}
    for device in (1, 2):
        mine = [r for r in rows if r[0] == device]
        inside = [r for r in mine if r[1] < base + dt.timedelta(hours=1)]
        for a, b in zip(inside, inside[1:]):
            stop, start = a[3] == 1 and b[3] != 1, a[3] != 1 and b[3] == 1
            for f in frames:
                if (f.change == "stop" and stop) or (f.change == "start" and start):
                    anchor = (a if f.anchor == "before" else b)[1]
                    near = [r for r in mine if f.lo_s <= (r[1] - anchor).total_seconds() <= f.hi_s and r[3] == 1 and r[4]]
                    if near:
                        warm = [r[5] for r in near if r[5] is not None]
                        want[device, f.name, anchor + dt.timedelta(seconds=f.shift_s)] = (len(near), sum(r[4] for r in near) / len(near), sum(warm) / len(warm) if warm else None)
    assert len(want) > 100 and got.keys() == want.keys()
    for key, (n, watts, warm) in want.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(watts, abs=1e-9) and got[key][2] == (None if warm is None else pytest.approx(warm, abs=1e-9)), key
    # exactly at a threshold: the mean of equal readings is that reading
    assert {v[1] for v in got.values() if v[0] == 1} <= {0.1, 1.0, 159.999999, 160.0}


def test_openings_are_pushed_into_the_look_back(spark, tmp_path, world):
    path = str(tmp_path / "sensor")
    world.sensor.write.parquet(path)
    stored = replace(world, sensor=spark.read.schema(world.sensor.schema).parquet(path))
    plan = explained(eng.no_door_openings(stored, "2024-01-07", "2024-01-15"))
    pushed = [p for p in re.findall(r"PushedFilters: \[(.*?)\]\n", plan) if "GreaterThan(SDXC,0)" in p]
    assert pushed and "LeftSemi" in plan


def test_readings_of_devices_without_codes_are_not_shuffled(fleet):
    plan = explained(eng.daq_codes(fleet, START, END, "Week", LIMITS))
    assert "measureddtm" not in " ".join(k for k in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if "single" not in k)
    assert plan.count("LeftSemi") >= 1


def by_hand(events, readings, code, column, pick, condition):
    out = {}
    for device in {e[0] for e in events}:
        at = min((e[2] for e in events if e[0] == device and e[1] == code), default=None)
        found = [r[column] for r in readings if at is not None and r["fridgeid"] == device and at <= r["measureddtm"] < at + dt.timedelta(days=7) and condition(r) and r[column] is not None]
        out[device] = pick(found) if found else None
    return out


@pytest.mark.parametrize("most", [100_000, 0])
def test_hour_summaries_equal_single_readings_at_the_borders(spark, most):
    rnd = random.Random(8)
    base = dt.datetime(2024, 1, 7)
    events = [(d, c, base + dt.timedelta(seconds=rnd.randrange(3 * 86400))) for d in (1, 2, 3) for c in rnd.sample(["5881", "5882", "5888", "5889", "5084"], 3)]
    readings = []
    for d in (1, 2, 3, 4):
        for e in [x for x in events if x[0] == d] or [(4, "", base)]:
            for edge in (e[2], e[2] + dt.timedelta(days=7)):  # dense around both borders
                readings += [(d, edge + dt.timedelta(seconds=s), rnd.choice([0, 1, 1]), *(rnd.uniform(-5, 900) for _ in range(4))) for s in (-3600, -59, -1, 0, 1, 61, 3599, 3601)]
        readings += [(d, base + dt.timedelta(seconds=rnd.randrange(12 * 86400)), 1, *(rnd.uniform(0, 800) for _ in range(4))) for _ in range(40)]
    sensor = spark.createDataFrame(readings, "fridgeid long, measureddtm timestamp, SCPX int, EWCP2 double, TEVIN double, TCPDISCTL double, ECDBAT double")
    frame = spark.createDataFrame(events, "fridgeid long, id string, EventTime timestamp")
    got = {(r["fridgeid"], r["id"]): r["code_value"] for r in eng.code_values(frame, sensor, base, base + dt.timedelta(days=3), Limits(), most).collect()}
    rows = sensor.collect()
    running = lambda r: r["SCPX"] == 1
    text = lambda v: spark.range(1).select(eng.number_text(F.lit(v).cast("double"))).first()[0]
    for code, column, pick in (("5881", "EWCP2", max), ("5889", "TEVIN", min)):
        for device, value in by_hand(events, rows, code, column, pick, running).items():
            assert got.get((device, code)) == (None if value is None else text(value)), (device, code)
    for device, value in by_hand(events, rows, "5888", "TCPDISCTL", max, lambda r: True).items():
        assert got.get((device, "5888")) == (None if value is None else text(value))


def test_sides_are_broadcast_only_up_to_a_size(spark):
    few, many = spark.range(5), spark.range(50)
    plan = lambda side: explained(spark.range(1000).hint("merge").join(side, "id", "left_semi"))
    assert "BroadcastHashJoin" in plan(small_side(few, 10)) and small_side(many, 10) is many


# --- last readings ---------------------------------------------------------------------------


def seen(frame):
    return {r["fridgeid"]: r["past_time"] for r in frame.collect()}


def test_state_is_carried_forward_and_equals_history(spark, fleet, tmp_path):
    path = str(tmp_path / "seen")
    days = ["2024-01-03", "2024-01-10", "2024-01-11", "2024-01-05", "2024-01-24", "2024-01-10"]  # one earlier, one again
    for day in days:
        want = {r[0]: r[1] for r in fleet.sensor.where(F.col("measureddtm") < day).groupBy("fridgeid").agg(F.max("measureddtm")).collect()}
        assert seen(last_seen(fleet, path, day)) == want, day
    assert len(sinks.parts(spark, path)) == 5
    assert seen(last_seen(fleet, path, "2024-01-10", rebuild=True)) == want


def test_a_run_after_the_first_reads_no_history(spark, tmp_path, world):
    root = str(tmp_path / "sensor")
    world.sensor.withColumn("measured_day", F.to_date("measureddtm")).write.partitionBy("measured_day").parquet(root)
    stored = replace(world, sensor=spark.read.parquet(root))
    last_seen(stored, str(tmp_path / "seen"), "2024-01-07")
    jobs.run_weekly_tech(stored, str(tmp_path / "tech"), "2024-01-15", state=str(tmp_path / "seen"))
    report = tech_report(stored, "2024-01-07", "2024-01-14", seen=last_seen(stored, str(tmp_path / "seen"), "2024-01-07"))
    plan = explained(report)
    sensor = [b for b in re.split(r"\n\n(?=\(\d+\))", plan) if "Scan parquet" in b and root in b]
    assert sensor and all("measured_day" in b and re.search(r">= 2024-01-0[0-9]|>= \d{5}", b) for b in sensor)


def test_reports_with_and_without_the_state_are_equal(spark, fleet, tmp_path):
    window = ("2024-01-21", "2024-01-28")
    last_seen(fleet, str(tmp_path / "s"), "2024-01-14")
    with_state = tech_report(fleet, *window, limits=LIMITS, excluded=EXCLUDED, seen=last_seen(fleet, str(tmp_path / "s"), window[0]))
    plain = tech_report(fleet, *window, limits=LIMITS, excluded=EXCLUDED)
    assert sorted(map(repr, with_state.collect())) == sorted(map(repr, plain.collect()))


def test_jobs_and_readers_take_the_current_time(spark, world, tmp_path):
    clock = lambda: dt.datetime(2024, 1, 14, 5)
    from coldtrail import schema
    from coldtrail.plans import readers

    jobs.run_weekly_eng(world, str(tmp_path / "a"), clock=clock)
    jobs.run_weekly_eng(world, str(tmp_path / "b"), "2024-01-14 05:00:00")
    shown = [sinks.read_report(spark, str(tmp_path / x), schema.REPORT_ENG) for x in "ab"]
    assert sorted(map(repr, shown[0].collect())) == sorted(map(repr, shown[1].collect())) and shown[0].count()
    assert sorted(map(repr, readers.read_eng(shown[0], clock=clock).collect())) == sorted(map(repr, readers.read_eng(shown[0], clock()).collect()))
    jobs.run_weekly_tech(world, str(tmp_path / "c"), clock=lambda: dt.datetime(2024, 1, 15, 3))
    report = sinks.read_report(spark, str(tmp_path / "c"), schema.REPORT_TECH)
    assert {r["StartDate"] for r in report.select("StartDate").collect()} == {dt.date(2024, 1, 7)}
    assert abs((readers.utc_now() - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 5
