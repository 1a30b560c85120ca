from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldtrail import schema
from coldtrail.limits import Limits
from coldtrail.plans import jobs, readers, suppress
from coldtrail.plans.eng_report import eng_report, new_rows
from coldtrail.plans.fleet import eng_location, fleet, history_fleet, latest_location
from coldtrail.plans.tech_report import tech_report
from coldtrail.sources import sinks
from coldtrail.sources.tables import between, read_series, read_sim_billing
from compare import explained
from fixtures import T0, WEEK, at, error, frame, make_fleet, place, reading

FINDING = "fridgeid long, Priority string, Message string, Detail string, value double, errCnt int"


def findings(spark, *rows):
    return spark.createDataFrame([(d, None, m, "d", v, None) for d, m, v in rows], FINDING)


def messages(rows):
    return sorted((r.fridgeid, r.Message) for r in rows.collect())


def test_offline_devices_keep_one_finding(spark):
    rows = findings(spark, (1, "Missing Data", 0.0), (1, "Missing Power Board Data", 0.0), (2, "Missing Data", 0.1), (2, "Other", 1.0))
    out = suppress.suppress(rows)
    assert messages(out) == [(1, "Unit Offline"), (2, "Missing Data"), (2, "Other")]
    assert out.where("fridgeid = 1").first().value is None


def test_power_precedence(spark):
    rows = findings(spark, (1, "Line Frequency Abnormal", 50.0), (2, "Missing Power Board Data", 0.0), (2, "Low Mains Power Availability", 2.0),
                    (3, "Low Mains Power Availability", 0.5), (3, "Line Frequency Abnormal", 50.0))
    literal = [(2, "Missing Power Board Data"), (3, "Low Mains Power Availability")]
    assert messages(suppress.suppress(rows)) == literal
    assert messages(suppress.suppress(rows, intended_precedence=True)) == sorted([(1, "Line Frequency Abnormal"), *literal])
    assert messages(suppress.suppress(rows, "v4")) == [
        (1, "Line Frequency Abnormal"), (2, "Low Mains Power Availability"), (3, "Line Frequency Abnormal"), (3, "Low Mains Power Availability")]


def test_suppression_is_idempotent(spark):
    rows = findings(spark, (1, "Solar Power Disconnected", 9.0), (1, "Low Solar Power", 3.0), (2, "Low Solar Power", 3.0), (3, "Missing Data", 0.0))
    once = suppress.suppress(rows)
    assert messages(once) == messages(suppress.suppress(once)) == [(1, "Solar Power Disconnected"), (2, "Low Solar Power"), (3, "Unit Offline")]


@pytest.fixture(scope="module")
def world(spark):
    history = [
        place(1, "China", T0, 1), place(1, "DRC", at(10), 2, report=1), place(2, "DRC", T0, 3), place(2, "China", at(10), 4),
        place(3, "Kenya", T0, 5), place(3, "Mali", T0, 6), place(4, "Kenya", T0, 7), place(5, "Kenya", T0, 8)]
    sensor = [reading(1, at(600 * i), EVLN=200 if i % 50 else 400, SCPX=1, EWCP2=200 if i else 0, TVCTOPCTL=4, TVCBOT=6, CTBH=9, SLNX=1, SDXC=0, TAMDAQ=20,
                      TICMCTL=1, TICBKCTL=1, EVDBAT=5) for i in range(1008)]
    sensor += [reading(3, at(days=-20, hours=-5))]
    sensor += [reading(5, at(600 * i), EVLN=400) for i in range(5)]
    return make_fleet(spark, sensor=sensor, errors=[error(1, at(3600), "E0A1")], history=history, devices=[1, 2, 3, 4, 5],
                      groups=[(4, "freezer"), (5, "solar")])


def test_fleets(world):
    assert {(r.fridgeid, r.country) for r in latest_location(world.location_history).collect()} == {
        (1, "DRC"), (2, "China"), (3, "Mali"), (4, "Kenya"), (5, "Kenya")}
    assert {(r.fridgeid, r.country) for r in eng_location(world).collect()} == {(1, "DRC"), (2, "DRC"), (3, "Mali"), (5, "Kenya")}
    assert {(r.fridgeid, r.fridgeType) for r in fleet(world).collect()} == {(1, "M"), (3, "M"), (5, "S")}
    assert {r.fridgeid for r in fleet(world, " drc ").collect()} == {1}
    assert {r.fridgeid for r in fleet(world, "china").collect()} == {2}
    assert {r.fridgeid for r in history_fleet(world).collect()} == {1, 2, 3, 5}


def test_tech_report_row(world):
    rows = {(r.FridgeId, r.Message): r for r in tech_report(world, *WEEK).collect()}
    offline = rows[3, "Unit Offline"]
    assert [k for k in rows if k[0] == 3] == [(3, "Unit Offline")]
    assert (offline.CTBH, offline.SLNX, float(offline.DataRx), offline.DataAge, offline.Country) == (None, None, 0.0, "27d 5h", "Mali")
    # five slots of 1,008: some data, but too little for any other finding
    assert [k for k in rows if k[0] == 5] == [(5, "Missing Data")]
    assert rows[5, "Missing Data"].FridgeType == "S" and float(rows[5, "Missing Data"].DataRx) == 0.5
    assert not [k for k in rows if k[0] in (2, 4)]
    older = {(r.FridgeId, r.Message) for r in tech_report(world, *WEEK, rules="v5").collect()}
    assert (5, "Missing Control Board Data") in older


def test_healthy_device_columns(world):
    sensor = world.sensor.where("fridgeid = 1")
    slow = replace(Limits(), samples_per_day=144.0, leak_max_w=250.0)
    rows = tech_report(replace(world, sensor=sensor), *WEEK, limits=slow).where("FridgeId = 1").collect()
    (row,) = rows
    assert row.Message == "Possible refrigerant leak"
    assert (float(row.TVCTOPCTLavg), float(row.CTBH), float(row.SLNX), float(row.DataRx), row.Deployed) == (5.0, 9.0, 100.0, 100.0, "Y")
    assert (row.CompRunAgeMin, row.CompRunAge, row.DataAge, row.FridgeShortSN) == (10, "0d 0h", "0d 0h", "SN1")
    assert row.Link.endswith("fridgeid=1&start=1704556800&stop=1705219200")


def test_second_eng_run_adds_only_rows_without_a_time(spark, world):
    rows = eng_report(world, *WEEK, run_time="2024-01-15")
    stored = spark.createDataFrame(rows.collect(), schema.REPORT_ENG)
    again = new_rows(rows, stored).collect()
    assert again and all(r.EventTime is None for r in again)
    assert any(r.Message == "Door Openings" for r in again)


def test_eng_jobs_replace_and_append(spark, world, tmp_path):
    path, run = str(tmp_path / "eng"), "2024-01-14 05:00:00"
    jobs.run_weekly_eng(world, path, run)
    first = sinks.read_report(spark, path, schema.REPORT_ENG).collect()
    assert {r.StartDate for r in first} == {dt.date(2024, 1, 7)} and {r.CreatedDtm for r in first} == {dt.datetime(2024, 1, 14, 5)}
    jobs.run_weekly_eng(world, path, run)
    assert sinks.read_report(spark, path, schema.REPORT_ENG).count() == len(first)
    jobs.populate_eng(world, path, dt.date(2024, 1, 7), dt.date(2024, 1, 15), run_time=run)
    timeless = [r for r in first if r.EventTime is None]
    assert sinks.read_report(spark, path, schema.REPORT_ENG).count() == len(first) + len(timeless)
    shown = readers.read_eng(sinks.read_report(spark, path, schema.REPORT_ENG), run)
    failed = shown.where("Message = 'too many failed starts'").first()
    assert failed.EventTime == "07-Jan-2024 01:00:00" and "var-ERRORS=E0A1" in failed.Link
    assert [(r.Country, r.L1, r.L3, r.FridgeId) for r in shown.collect()] == sorted((r.Country, r.L1, r.L3, r.FridgeId) for r in shown.collect())
    empty = replace(world, sensor=world.sensor.where("false"), errors=world.errors.where("false"))
    jobs.run_weekly_eng(empty, path, run)
    assert sinks.read_report(spark, path, schema.REPORT_ENG).count() == 0


def test_tech_jobs(spark, world, tmp_path):
    path, run = str(tmp_path / "tech"), "2024-01-15"
    assert readers.tech_window(run) == (dt.date(2024, 1, 7), dt.date(2024, 1, 14))
    one = jobs.refreshed_tech(world, path, run, "Kenya").count()
    assert one == 1 and jobs.refreshed_tech(world, path, run, "kenya").count() == one
    everything = jobs.refreshed_tech(world, path, run)
    assert {r.Country for r in everything.collect()} == {"DRC", "Kenya", "Mali"}
    assert everything.schema["value"].dataType == T.DecimalType(8, 0)
    jobs.run_weekly_tech(world, path, "2024-01-16")
    stored = sinks.read_report(spark, path, schema.REPORT_TECH)
    assert {r.StartDate for r in readers.rows_per_start(stored).collect()} == {dt.date(2024, 1, 8)}


def test_report_schemas(world):
    assert eng_report(world, *WEEK, run_time="2024-01-15").schema.simpleString() == schema.REPORT_ENG.simpleString()
    assert tech_report(world, *WEEK).schema.simpleString() == schema.REPORT_TECH.simpleString()


def test_day_folders_are_pruned_with_the_slack(spark, tmp_path):
    rows = frame(spark, schema.SENSOR, [reading(1, at(days=d, hours=12)) for d in range(5)])
    path = str(tmp_path / "sensor")
    rows.withColumn("measured_day", F.to_date("measureddtm")).write.partitionBy("measured_day").parquet(path)
    series = read_series(spark, path, schema.SENSOR)
    cut = between(series, at(days=2), at(days=3), back_s=86400)
    assert sorted(r.measureddtm for r in cut.collect()) == [at(days=1, hours=12), at(days=2, hours=12)]
    plan = explained(cut)
    assert "measured_day" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(measureddtm" in plan


def test_sim_billing_has_the_declared_schema(spark, tmp_path):
    path = str(tmp_path / "billing")
    spark.createDataFrame([], schema.SIM_BILLING).write.parquet(path)
    assert read_sim_billing(spark, path).columns == schema.SIM_BILLING.names
    with pytest.raises(ValueError):
        read_sim_billing(spark)


def test_scarce_devices_keep_the_missing_data_finding_if_they_have_a_record(spark):
    rows = spark.createDataFrame(
        [(d, None if d == 2 else d, m, 0.5) for d in (1, 2) for m in (suppress.MISSING_DATA, suppress.FREQUENCY)], "fridgeid long, device_id long, Message string, DataRx double")
    kept = suppress.only_missing_data_when_scarce(rows, "device_id is not null").collect()
    assert sorted((r.fridgeid, r.Message) for r in kept) == [(1, suppress.MISSING_DATA), (2, suppress.FREQUENCY), (2, suppress.MISSING_DATA)]


def test_reading_a_fleet_needs_a_utc_session(spark):
    from coldtrail.sources.tables import read_fleet

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError, match="Paris"):
            read_fleet(spark, "nowhere")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
