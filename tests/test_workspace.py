from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldtrail.sources import sinks, workspace

STRUCT = T.StructType([T.StructField("StartDate", T.DateType()), T.StructField("EventTime", T.TimestampType()), T.StructField("n", T.IntegerType())])


def rows(spark, day, *numbers):
    at = dt.datetime(2024, 1, day)
    return spark.createDataFrame([(dt.date(2024, 1, day), at + dt.timedelta(hours=n), n) for n in numbers], STRUCT)


def listed(frame):
    return sorted((r.StartDate.day, r.n) for r in frame.collect())


def test_stored_folders_can_be_cleared(spark):
    frame = workspace.stored(spark.range(5).groupBy("id").count(), "some")
    place = frame.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(place) and spark.conf.get(workspace._FREE_SHUFFLES) == "false"
    assert workspace.clear_stored(spark) >= 1 and not os.path.exists(place)


def test_replace_append_and_clear(spark, tmp_path):
    path, one, two = str(tmp_path / "t"), {"StartDate": dt.date(2024, 1, 1)}, {"StartDate": dt.date(2024, 1, 2)}
    assert sinks.read_report(spark, path, STRUCT).count() == 0
    sinks.replace_window(rows(spark, 1, 1, 2), path, one, "EventTime")
    sinks.append_window(rows(spark, 2, 3), path, two, "EventTime")
    sinks.append_window(rows(spark, 1, 4), path, one, "EventTime")
    assert listed(sinks.read_report(spark, path, STRUCT)) == [(1, 1), (1, 2), (1, 4), (2, 3)]
    sinks.replace_window(rows(spark, 1, 9), path, one, "EventTime")
    assert listed(sinks.read_report(spark, path, STRUCT)) == [(1, 9), (2, 3)]
    assert listed(sinks.read_report(spark, path, STRUCT, two)) == [(2, 3)]
    assert sinks.remove_unlisted(spark, path) == 2 and listed(sinks.read_report(spark, path, STRUCT)) == [(1, 9), (2, 3)]
    sinks.replace_report(rows(spark, 2, 5), path, two)
    assert listed(sinks.read_report(spark, path, STRUCT)) == [(2, 5)]


def test_a_write_that_fails_half_way_leaves_the_old_rows(spark, tmp_path):
    path, one = str(tmp_path / "t"), {"StartDate": dt.date(2024, 1, 1)}
    sinks.replace_window(rows(spark, 1, 1, 2), path, one, "EventTime")
    broken = rows(spark, 1, 7, 8, 0).repartition(3).withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("int"))
    for replace in (lambda: sinks.replace_window(broken, path, one, "EventTime"), lambda: sinks.replace_report(broken, path, one)):
        with pytest.raises(Exception, match="no"):
            replace()
        assert listed(sinks.read_report(spark, path, STRUCT)) == [(1, 1), (1, 2)]
    assert sinks.unlisted_folders(spark, path)


def test_only_folders_that_can_match_are_opened(spark, tmp_path):
    path = str(tmp_path / "t")
    for day in range(1, 9):
        sinks.replace_window(rows(spark, day, 1, 2), path, {"StartDate": dt.date(2024, 1, day)}, "EventTime")
    near = sinks.read_between(spark, path, STRUCT, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4, 1))
    folders = {file.rsplit("/", 1)[0] for file in near.inputFiles()}
    assert listed(near) == [(3, 1), (3, 2), (4, 1)] and len(folders) == 2
    assert listed(sinks.read_between(spark, path, STRUCT, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4, 1), {"StartDate": dt.date(2024, 1, 3)})) == [(4, 1)]


def test_a_federated_read_must_be_split(spark):
    from coldtrail.sources.tables import read_sim_billing

    with pytest.raises(ValueError, match="path"):
        read_sim_billing(spark)
    with pytest.raises(ValueError, match="lowerBound, upperBound"):
        read_sim_billing(spark, jdbc_url="jdbc:none", options={"partitioncolumn": "DEVICE_ID", "numPartitions": "8"})
