"""Plans that hold at scale: no pairwise joins, no window over a whole device's readings."""

from __future__ import annotations

import re

import pytest

from coldtrail.operators import eng, tech
from coldtrail.operators.edges import edge_power, trip_frames
from coldtrail.operators.findings import render
from coldtrail.operators.runs import last_compressor_run
from coldtrail.plans.eng_report import eng_report
from coldtrail.plans.tech_report import tech_report
from coldtrail.sources.events_adapter import fleet_from_events
from compare import explained
from oracle.settings import END, EXCLUDED, LIMITS, RUN_TIME, START

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fleet(spark):
    return fleet_from_events(spark, FOLDER)


def reports(fleet):
    return {
        "eng": lambda: eng_report(fleet, START, END, run_time=RUN_TIME, limits=LIMITS, excluded=EXCLUDED),
        "tech": lambda: tech_report(fleet, START, END, limits=LIMITS, excluded=EXCLUDED)}


@pytest.mark.parametrize("name", ["eng", "tech"])
def test_reports_have_no_pairwise_join_and_no_python(fleet, name):
    plan = explained(reports(fleet)[name]())
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SinglePartition"):
        assert slow not in plan, slow


def exchange_keys(plan: str) -> list[str]:
    return re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)


@pytest.mark.parametrize("build", [
    lambda t: edge_power(t.sensor, START, END, trip_frames(LIMITS)),
    lambda t: last_compressor_run(t.sensor, START, END, LIMITS),
    lambda t: tech.battery_drain(t, START, END, LIMITS)], ids=["edges", "runs", "drain"])
def test_readings_are_shuffled_by_device_and_chunk(fleet, build):
    first = exchange_keys(explained(build(fleet)))[0]
    assert "fridgeid" in first and "chunk" in first


def test_edge_frames_share_one_shuffle_of_the_readings(fleet):
    plan = explained(edge_power(fleet.sensor, START, END, trip_frames(LIMITS)))
    assert sum("chunk" in keys for keys in exchange_keys(plan)) == 1


def test_columns_are_pruned(fleet):
    plan = explained(render(eng.high_voltage(fleet, START, END, "Day", LIMITS), fleet.device_group))
    schema = re.findall(r"ReadSchema: (\S+)", plan)[0]
    assert "event_type" not in schema and "props" not in schema


def test_counters_aggregate_by_hash(fleet):
    plan = explained(tech.detect(["missing_data", "battery_missing", "low_temperature"], fleet, fleet.device, START, END, LIMITS))
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
