from __future__ import annotations

from dataclasses import replace

import pytest

from coldtrail.limits import Limits
from coldtrail.operators import tech
from coldtrail.operators.profile import counters, derived, device_profile
from fixtures import WEEK, at, error, make_fleet, reading


def found(fleet, *rules, limits=Limits()):
    return {(r.fridgeid, r.Message, r.Detail, r.value, r.errCnt) for r in tech.detect(rules, fleet, fleet.device, *WEEK, limits).collect()}


def test_device_without_rows_has_zero_counts_and_null_sums(spark):
    fleet = make_fleet(spark, devices=[1])
    assert found(fleet, "missing_data") == {(1, "Missing Data", "Data Rx %", 0.0, None)}
    assert found(fleet, "low_mains_power", "low_solar_power", "dirty_panels", "no_solar_power", "refrigerant_leak", "line_frequency",
                 "battery_missing", "low_temperature") == set()
    assert {m for _, m, *_ in found(fleet, *tech.SENSOR_PRESENCE)} == {"USB Board - Control Sensor Error", "No Calculated Holdover"}
    assert found(fleet, "solar_undersatisfied", "solar_no_ice") == {(1, "Solar Fridge Low Ice", "Not Enough Ice", None, None)}


@pytest.mark.parametrize("states, detail", [([6], None), ([6, 6], "Undersatisfied"), ([6, 6, 2], None), ([0, 1], "Not Enough Ice")])
def test_solar_low_ice(spark, states, detail):
    fleet = make_fleet(spark, sensor=[reading(1, at(10 * i), SCPX=s) for i, s in enumerate(states)], devices=[1])
    assert {d for _, _, d, _, _ in found(fleet, "solar_undersatisfied", "solar_no_ice")} == ({detail} if detail else set())


def test_data_rx_counts_ten_minute_slots(spark):
    full = [reading(1, at(600 * i + j)) for i in range(1008) for j in (0, 10)]
    part = [reading(2, at(600 * i)) for i in range(504)]
    fleet = make_fleet(spark, sensor=full + part, devices=[1, 2])
    assert found(fleet, "missing_data") == {(2, "Missing Data", "Data Rx %", 50.0, None)}
    assert {(r.fridgeid, float(r.dataRx)) for r in tech.data_rx(fleet, fleet.device, *WEEK).collect()} == {(1, 100.0), (2, 50.0)}


def test_line_frequency_reads_literally(spark):
    sensor = [reading(1, at(10 * i), EVLN=v, EHZLN=h) for i, (v, h) in enumerate([(200, 40), (200, 50), (300, 50), (300, 50)])]
    assert found(make_fleet(spark, sensor=sensor, devices=[1]), "line_frequency") == {
        (1, "Line Frequency Abnormal", "In Range %", 50.0, 50)}


def test_battery_hours_and_low_days(spark):
    sensor = [reading(1, at(hours=h, minutes=m), EVDBAT=v, TVCTOPCTL=t) for h, m, v, t in (
        (0, 0, 0.1, 1), (0, 5, 0.3, 5), (1, 0, 0.1, 5), (2, 0, 0.19, 1), (30, 0, 0.2, 1))]
    fleet = make_fleet(spark, sensor=sensor, devices=[1])
    assert found(fleet, "battery_missing") == {(1, "Battery Missing Error", "1-hour Max Batt < .2 v", None, 2)}
    assert found(fleet, "low_temperature") == {(1, "Low Temperature Alert", "Days (Count)", 2.0, None)}


def test_newest_holdover_may_be_missing(spark):
    fleet = make_fleet(spark, sensor=[reading(1, at(0), CTBH=5), reading(1, at(10), CTBH=None), reading(2, at(5), CTBH=7), reading(2, at(5), CTBH=8)])
    rows = {r.fridgeid: r.ctbh_last for r in device_profile(fleet, *WEEK, {"ctbh_last", "slots"}).collect()}
    assert rows == {1: None, 2: 8.0}


def test_profile_is_one_scan_of_a_shared_table(spark):
    fleet = make_fleet(spark, sensor=[reading(1, at(0))])
    plan = device_profile(fleet, *WEEK, set(counters(Limits())) | set(derived(Limits())))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan


def test_door_islands_join_the_last_hour_before_a_gap_to_the_next(spark):
    fleet = make_fleet(spark, errors=[error(1, at(hours=h), "5404") for h in (1, 2, 3, 10, 11)])
    (row,) = tech.long_door_open(fleet, *WEEK, replace(Limits(), door_hours=2)).collect()
    assert row.value == 3.0


def test_sd_card_sums_distinct_counts(spark):
    errors = [error(1, at(i), "6782", f"card ({n})") for i, n in enumerate((5, 5, 30))]
    errors += [error(2, at(i), "6784", "card (10)") for i in range(3)]
    fleet = make_fleet(spark, errors=errors)
    assert [(r.fridgeid, r.Detail, r.value, r.errCnt) for r in tech.sd_card_errors(fleet, *WEEK).collect()] == [(1, "card Error Count", 35.0, 35)]


def test_alarm_days(spark):
    fleet = make_fleet(spark, errors=[error(1, at(h * 3600), c) for h, c in ((0, "4406"), (1, "6402"), (25, "4406"), (49, "5404"))])
    assert [(r.value) for r in tech.alarm_days(fleet, *WEEK).collect()] == [2.0]


def trips(device, states):
    return [reading(device, at(10 * i), SCPX=s, EWCP2=0.5) for i, s in enumerate(states)]


def test_mech_trips_by_variant(spark):
    stop, begin, long_begin = [1] * 12 + [0], [0] + [1] * 12, [0] + [1] * 60
    fleet = make_fleet(spark, sensor=trips(1, stop) + trips(2, begin) + trips(3, long_begin))
    assert {(r.fridgeid, r.value) for r in tech.mech_trips(fleet, *WEEK).collect()} == {(1, 1.0), (2, 1.0), (3, 1.0)}
    assert {r.fridgeid for r in tech.mech_trips_slow_start(fleet, *WEEK).collect()} == {3}
    assert tech.mech_trips_slow_stop(fleet, *WEEK).collect() == []


def test_battery_drain_uses_the_worst_pair(spark):
    sensor = [reading(1, at(0), ECDBAT=9), reading(1, at(100), ECDBAT=5), reading(1, at(86400), ECDBAT=8), reading(1, at(86500), ECDBAT=2.5),
              reading(2, at(0), ECDBAT=9), reading(2, at(86400 + 3600), ECDBAT=1)]
    fleet = make_fleet(spark, sensor=sensor)
    assert [r.fridgeid for r in tech.battery_drain(fleet, *WEEK).collect()] == [1]
    (pair,) = [r for r in tech.first_battery_pair(fleet, *WEEK).collect()]
    assert (pair.fridgeid, pair.startDtm, pair.endDtm, pair.battDiff) == (1, at(0), at(86400), -1.0)


@pytest.mark.parametrize("old, new", [((1 << 32) - 1, 1 << 32), ((1 << 33) - 1, 1 << 33), (-1, (1 << 63) - 1)])
def test_newest_holdover_by_id_within_a_second(spark, old, new):
    rows = [reading(1, at(), CTBH=5) | {"reading_id": new}, reading(1, at(), CTBH=9) | {"reading_id": old}]
    fleet = make_fleet(spark, sensor=rows, devices=[1])
    assert [r.ctbh_last for r in device_profile(fleet, *WEEK, {"ctbh_last", "slots"}).collect()] == [5.0]
