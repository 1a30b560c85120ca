"""What the engineering report spends on each reading: bounds, keys, texts and scans of the fleet."""

from __future__ import annotations

import random
import re
from dataclasses import replace

from pyspark.sql import functions as F

from compare import explained
from fixtures import WEEK, at, error, make_fleet, place, reading

from coldtrail.functions.orderkey import bits_of, packed, packed_rank, rank_of, turned_rank
from coldtrail.functions.text import number_text
from coldtrail.operators import eng
from coldtrail.plans.eng_report import eng_report
from coldtrail.plans.fleet import eng_location, located_fleet, placed_fleet


def _world(spark):
    history = [place(1, "DRC"), place(1, "Mali", at(days=1), 1), place(2, "China"), place(3, "China", at(days=2), 2), place(3, "Mali"),
               place(4, "Kenya"), place(5, None), place(6, "Mali", number=3), place(6, "Kenya", number=3)]
    return make_fleet(spark, sensor=[reading(d, at(hours=d), EVLN=300 + d, SCPX=1) for d in range(1, 7)], history=history, devices=[1, 2, 3, 4, 4, 6],
                      groups=[(1, "solar"), (4, "freezer")])


def test_the_report_reads_the_location_history_once(spark, tmp_path):
    fleet = _world(spark)
    path = str(tmp_path / "history")
    fleet.location_history.write.parquet(path)
    stored = replace(fleet, location_history=spark.read.parquet(path))
    plan = explained(eng_report(stored, *WEEK, run_time="2024-01-15"))
    assert len(re.findall(r"Location: .*history", plan)) == 1


def test_place_of_the_fleet_equals_the_newest_place_outside_the_excluded_country(spark):
    fleet = _world(spark)
    for country in ("All", "Mali", "China"):
        names = ["fridgeid", "FridgeShortSN", "fridgeType"]
        place_of = eng_location(fleet).select("fridgeid", "country", "L1", "L3")
        want = placed_fleet(fleet, country).select(*names).join(place_of, "fridgeid", "left")
        got = located_fleet(fleet, country)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect())), country


def test_derived_times_are_worked_out_for_rows_in_the_stored_window_only(spark):
    from coldtrail.sources.tables import STORED_TIME, between

    frame = spark.range(3).selectExpr("timestamp_seconds(id + rand()) as measureddtm", f"timestamp_ntz '2024-01-01' as {STORED_TIME}", "id")
    plan = between(frame, "2024-01-01", "2024-01-02")._jdf.queryExecution().analyzed().toString()
    assert plan.index(STORED_TIME + "#") < plan.index("measureddtm#", plan.index("Filter"))


def test_short_numbers_keep_the_formatted_text(spark):
    chance = random.Random(5)
    values = [0.0, -0.0, 1.0, -1.0, 0.001, 0.0009999, 0.00012, 999999.0, 999999.5, 1e6, 12345.0, 123456.0, 1234567.0, -2.5, -123.25, 117.08000000000001,
              1e-7, 1e20, float("nan"), float("inf"), 100.0, 0.1 + 0.2, None]
    values += [round(chance.uniform(-10**e, 10**e), d) for e in range(-3, 8) for d in range(6) for _ in range(20)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    shown = F.format_string("%.6g", F.col("v"))
    trimmed = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    slow = F.when(F.col("v").isNotNull(), F.regexp_replace(trimmed, r"e([+-])(\d\d)$", "e$10$2"))
    assert rows.select("v", number_text(F.col("v")).alias("a"), slow.alias("b")).where("not a <=> b").collect() == []


def test_rank_of_the_negative_equals_the_key_of_the_negative(spark):
    values = [0.0, -0.0, 1.5, -1.5, 1e300, -1e-300, float("inf"), float("-inf"), float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    rank = rank_of(bits_of(F.col("v")))
    when = F.timestamp_seconds(F.lit(7))
    keys = rows.select(packed(-F.col("v"), when).alias("a"), packed_rank(turned_rank(rank, F.col("v")), when).alias("b"))
    assert keys.where("not a <=> b").collect() == []


def test_values_beside_codes_shuffle_one_row_of_extremes_by_device(spark):
    fleet = make_fleet(
        spark, sensor=[reading(d, at(minutes=m), SCPX=1, EWCP2=100 + m, TEVIN=-m, TCPDISCTL=m, ECDBAT=m) for d in (1, 2, 3) for m in range(0, 6000, 7)],
        errors=[error(1, at(minutes=30), "5881"), error(1, at(minutes=33), "5889"), error(2, at(days=1), "5084")])
    events = eng._daq_rows(fleet, *WEEK)
    few = eng.code_values(events, fleet.sensor, *WEEK)
    assert "hour" not in explained(few)
    assert sorted(few.collect()) == sorted(eng.code_values(events, fleet.sensor, *WEEK, most=0).collect())
