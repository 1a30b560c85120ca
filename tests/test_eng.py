from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest

from coldtrail.limits import Limits
from coldtrail.operators import eng
from coldtrail.operators.findings import render
from fixtures import WEEK, at, error, make_fleet, reading

TWO_WEEKS = (WEEK[0], WEEK[0] + dt.timedelta(days=14))


def rows(fleet, operator, interval, window=WEEK, limits=Limits()):
    return render(operator(fleet, *window, interval, limits), fleet.device_group).collect()


def test_high_voltage_takes_the_day_maximum_and_links_first_to_last(spark):
    fleet = make_fleet(spark, sensor=[reading(1, at(0), EVLN=350.0), reading(1, at(10), EVLN=350.1), reading(1, at(20), EVLN=360),
                                      reading(1, at(30), EVLN=360), reading(1, at(40), EVLN=355)])
    (row,) = rows(fleet, eng.high_voltage, "Day")
    assert (row.value, row.RecCount, row.EventTime) == ("360", 4, at(20))
    begin = 1704585610
    assert row.link.endswith(f"fridgeid=1&start={begin - 600}&stop={begin + 30 + 600}")
    assert row.Glink is None and row.MessageInterval == "Day"


def test_window_is_half_open(spark):
    fleet = make_fleet(spark, sensor=[reading(1, WEEK[0] - dt.timedelta(seconds=1), EVLN=400), reading(1, WEEK[0], EVLN=401),
                                      reading(1, WEEK[1], EVLN=402)])
    assert [r.value for r in rows(fleet, eng.high_voltage, "All")] == ["401"]


@pytest.mark.parametrize("powers, count, detail", [
    ([1000.0], None, None), ([700.0], None, None), ([700.0, 800.0], 2, eng.MAINS_DAY_600), ([1200.0], 1, eng.MAINS_DAY_1000),
    ([1000.0, 1000.0, 700.0], None, None), ([700.0, 800.0, 1200.0], 2, eng.MAINS_DAY_600), ([700.0, 1200.0], 1, eng.MAINS_DAY_1000)])
def test_mains_power_counts(spark, powers, count, detail):
    fleet = make_fleet(spark, sensor=[reading(1, at(10 * i), EWCP2=p) for i, p in enumerate(powers)])
    found = rows(fleet, eng.high_compressor_power, "Day")
    assert [(r.RecCount, r.Detail) for r in found] == ([] if count is None else [(count, detail)])


def test_power_detectors_are_gated_by_class(spark):
    fleet = make_fleet(spark, sensor=[reading(d, at(10 * i), EWCP=131, EWCP2=1200) for d in (1, 2) for i in range(2)], groups=[(2, "Solar")])
    found = {(r.fridgeid, r.Message) for r in rows(fleet, eng.high_compressor_power, "day")}
    assert found == {(1, eng.MAINS_POWER), (2, eng.SOLAR_POWER[0])}


def test_chart_of_power_runs_from_lowest_to_highest_value(spark):
    fleet = make_fleet(spark, sensor=[reading(1, at(0), EWCP=200), reading(1, at(60), EWCP=140), reading(1, at(120), EWCP=180)], groups=[(1, "solar")])
    (row,) = rows(fleet, eng.high_compressor_power, "Day")
    begin = 1704585600
    assert f"start={begin + 60 - 7200}&stop={begin + 7200}" in row.link


def test_low_temperature_may_count_a_reading_twice(spark):
    fleet = make_fleet(spark, sensor=[reading(1, at(0), TVCTOPCTL=1.5, TVCBOT=-1), reading(1, at(10), TVCTOPCTL=2, TVCBOT=2)])
    (row,) = rows(fleet, eng.low_temperature, "Day")
    assert (row.RecCount, row.value, row.Detail) == (2, "-1", eng.LOW_BOTTOM)


def test_unsupported_intervals_are_named(spark):
    fleet = make_fleet(spark)
    for operator, interval in ((eng.high_voltage, "Week"), (eng.mech_thermostat, "Hour"), (eng.overlapping_data, "Day")):
        with pytest.raises(ValueError):
            operator(fleet, *WEEK, interval)


def trip(device, offset, states, powers):
    return [reading(device, at(offset + 10 * i), SCPX=s, EWCP2=p) for i, (s, p) in enumerate(zip(states, powers))]


def test_thermostat_trip_before_stop_and_after_start(spark):
    stop = trip(1, 0, [1] * 8 + [0], [0.5] * 9)
    begin = trip(2, 0, [0] + [1] * 8, [0.5] * 9)
    fleet = make_fleet(spark, sensor=stop + begin)
    found = {(r.fridgeid, r.EventTime, r.Detail) for r in rows(fleet, eng.mech_thermostat, "All")}
    assert found == {(1, at(70), eng.TRIP_STOP), (2, at(0), eng.TRIP_START)}


@pytest.mark.parametrize("last", [1, None])
def test_last_row_and_missing_state_are_no_edge(spark, last):
    fleet = make_fleet(spark, sensor=trip(1, 0, [1] * 8 + [last], [0.5] * 9))
    assert rows(fleet, eng.mech_thermostat, "All") == []


def test_week_pairs_every_first_with_every_last(spark):
    both = trip(1, 0, [1] * 8 + [0], [0.5] * 9) + trip(1, 3600, [0] + [1] * 8, [0.5] * 9)
    found = rows(make_fleet(spark, sensor=both), eng.mech_thermostat, "Week")
    assert len(found) == 4
    assert len({r.link for r in found}) == 4


def test_solar_week_needs_four_busy_hours(spark):
    def stuck(hours, per_hour):
        return [reading(1, at(10 * i, hours=h), SCPS=2000, ICPS=0, EWDCA=61) for h in range(hours) for i in range(per_hour)]

    groups = [(1, "solar")]
    assert rows(make_fleet(spark, sensor=stuck(3, 6), groups=groups), eng.mech_thermostat, "Week") == []
    assert rows(make_fleet(spark, sensor=stuck(4, 5), groups=groups), eng.mech_thermostat, "Week") == []
    (row,) = rows(make_fleet(spark, sensor=stuck(4, 6), groups=groups), eng.mech_thermostat, "Week")
    assert row.RecCount == 24


def test_low_charge_bands(spark):
    def shutdown(device, watts, ambient, samples=12):
        before = [reading(device, at(10 * i), SCPX=1, EWCP2=watts, TAMDAQ=ambient) for i in range(samples)]
        settle = [reading(device, at(10 * (samples + i)), SCPX=1, EWCP2=watts, TAMDAQ=ambient) for i in range(12)]
        return before + settle + [reading(device, at(10 * (samples + 12)), SCPX=0, EWCP2=0)]

    sensor = [r for d, (w, a) in enumerate([(159, 20), (159, 30), (165, 30), (165, 20), (0.5, 20)]) for r in shutdown(d, w, a)]
    found = {(r.fridgeid, r.Detail, r.value) for r in rows(make_fleet(spark, sensor=sensor), eng.low_charge, "Day")}
    assert found == {(0, eng.CHARGE_LOW, "159"), (2, eng.CHARGE_HIGH, "165")}
    few = make_fleet(spark, sensor=shutdown(9, 100, 20, samples=8))
    assert rows(few, eng.low_charge, "All") == []


def test_code_in_two_weeks_disappears(spark):
    fleet = make_fleet(spark, errors=[error(1, at(days=1), "640C"), error(1, at(days=8), "640C"), error(1, at(days=2), "4408"),
                                      error(1, at(days=3), "4408")])
    assert [(r.Message, r.RecCount, r.value) for r in rows(fleet, eng.daq_errors, "Week", TWO_WEEKS)] == [("DAQ Error : 4408", 2, None)]


def test_code_values_come_from_the_following_days(spark):
    sensor = [
        reading(1, at(hours=1), SCPX=1, EWCP2=900, ECDBAT=9), reading(1, at(hours=3), SCPX=1, EWCP2=150, TEVIN=4, TCPDISCTL=50, ECDBAT=7.5),
        reading(1, at(hours=4), SCPX=1, EWCP2=0.5, TEVIN=-3, ECDBAT=2), reading(1, at(hours=5), SCPX=0, EWCP2=950, TCPDISCTL=80, ECDBAT=1),
        reading(1, at(days=7, hours=2), SCPX=1, EWCP2=999)]
    errors = [error(1, at(hours=2), c) for c in ("5881", "5882", "5888", "5889", "5084")]
    errors += [error(1, at(hours=2), "5884", "7(5)"), error(1, at(hours=3), "5884", "")]
    found = {r.Message[-4:]: r.value for r in rows(make_fleet(spark, sensor=sensor, errors=errors), eng.daq_errors, "Week", TWO_WEEKS)}
    assert found == {"5881": "150", "5882": "150", "5888": "80", "5889": "-3", "5084": "[7.5,2]", "5884": "6"}


def test_sensor_codes_are_listed_once_per_week(spark):
    errors = [error(1, at(days=1), "6181", "0(1)"), error(1, at(days=2), "618B", "2(1)"), error(1, at(days=8), "6181", "9(1)"),
              error(1, at(days=1), "6181", "no count")]
    found = sorted(rows(make_fleet(spark, errors=errors), eng.daq_errors, "Week", TWO_WEEKS), key=lambda r: r.EventTime)
    assert [(r.Detail, r.value, r.RecCount, r.EventTime) for r in found] == [
        ("6181,618B", "9,TCDOUT,TEVIN", 3, at(days=1)), ("6181,618B", "9,TCDOUT,TEVIN", 3, at(days=8))]
    assert found[0].Glink.endswith("&var-ERRORS=6181&var-ERRORS=618B")


def test_no_door_openings_need_readings(spark):
    sensor = [reading(1, at(days=-3), SDXC=1), reading(1, at(days=-2), SDXC=0), reading(1, at(0), SDXC=0), reading(2, at(0), SDXC=None),
              reading(3, at(0), SDXC=1), reading(4, at(days=-100), SDXC=1), reading(4, at(0), SDXC=0)]
    found = {(r.fridgeid, r.RecCount, r.EventTime) for r in rows(make_fleet(spark, sensor=sensor), eng.no_door_openings, "Week")}
    assert found == {(1, 0, at(days=-3)), (4, 0, None)}


def test_bad_time_counts_distinct_timestamps(spark):
    bad = [{"fridgeid": 1, "createddtm": at(i)} for i in range(3)] * 2
    fleet = make_fleet(spark, bad_time=bad)
    assert [r.RecCount for r in rows(fleet, eng.bad_time, "All")] == [2, 2, 2]
    assert rows(fleet, eng.bad_time, "Day", limits=replace(Limits(), bad_time_min=3)) == []
    assert [r.RecCount for r in rows(fleet, eng.bad_time, "Day", limits=replace(Limits(), bad_time_min=2))] == [3]


def test_overlapping_hour(spark):
    fleet = make_fleet(spark, sensor=[reading(d, at(9 * i)) for d, n in ((1, 370), (2, 369)) for i in range(n)])
    assert [(r.fridgeid, r.RecCount) for r in rows(fleet, eng.overlapping_data, "Hour")] == [(1, 370)]
