"""Each device's last reading before a time, kept as a small table that every run carries forward."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timebucket import as_datetime
from ..sources.sinks import parts, publish, read_parts, REPLACE
from ..sources.tables import FleetTables, between

STATE = "fridgeid long, past_time timestamp"


def _until(window: str) -> dt.datetime:
    return dt.datetime.fromisoformat(window.removeprefix("until="))


def newest(t: FleetTables, since, until) -> DataFrame:
    """(fridgeid, past_time): the last reading of each device from ``since`` (None: ever) to before ``until``, one row per device
    and task before the shuffle."""
    return between(t.sensor, since, until).groupBy("fridgeid").agg(F.max("measureddtm").alias("past_time"))


def last_seen(t: FleetTables, path: str, before, rebuild: bool = False) -> DataFrame:
    """(fridgeid, past_time): the last reading of each device before a time, from the state table at ``path``.

    The table has a version for each time asked for. The newest version that is not
    later than ``before`` is merged with the readings since, and stored as a version of
    its own; so a weekly run reads a week, and an earlier window asked for again gets
    what it got. The first run reads all history, and so does ``rebuild``, for readings that
    arrived after a version had passed their time.
    """
    spark, before = t.sensor.sparkSession, as_datetime(before)
    versions = {} if rebuild else {_until(p.window): p for p in parts(spark, path)}
    known = max((at for at in versions if at <= before), default=None)
    if known is None or known < before:
        state = newest(t, known, before)
        if known is not None:
            older = read_parts(spark, path, spark.createDataFrame([], STATE).schema, [versions[known]])
            state = state.unionByName(older).groupBy("fridgeid").agg(F.max("past_time").alias("past_time"))
        publish(state, path, {"until": before}, REPLACE)
    return _version(spark, path, before)


def _version(spark: SparkSession, path: str, before: dt.datetime) -> DataFrame:
    schema = spark.createDataFrame([], STATE).schema
    return read_parts(spark, path, schema, [p for p in parts(spark, path) if _until(p.window) == before])
