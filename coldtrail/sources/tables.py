"""The relations a report reads, and their scans."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.timebucket import epoch_of


@dataclass(frozen=True)
class FleetTables:
    """Source frames. The solar views default to the sensor table (one physical scan)."""

    sensor: DataFrame
    errors: DataFrame
    bad_time_errors: DataFrame
    location_history: DataFrame
    device: DataFrame
    device_group: DataFrame
    sensor_solar: DataFrame | None = None
    solar: DataFrame | None = None

    @property
    def solar_sensor(self) -> DataFrame:
        return self.sensor if self.sensor_solar is None else self.sensor_solar

    @property
    def pv(self) -> DataFrame:
        return self.solar_sensor if self.solar is None else self.solar


DAY_COLUMN = "measured_day"
#: A frame whose time is derived may carry the stored time (without a zone) under this name; it differs by less than a second.
STORED_TIME = "_stored_at"


def read_table(spark: SparkSession, path: str, struct: T.StructType) -> DataFrame:
    """Parquet with a declared schema, no inference pass over the files."""
    return spark.read.schema(struct).parquet(path)


def read_series(spark: SparkSession, path: str, struct: T.StructType) -> DataFrame:
    """Rows stored under ``measured_day=...`` folders; :func:`between` then prunes whole days."""
    return spark.read.schema(T.StructType([*struct.fields, T.StructField(DAY_COLUMN, T.DateType(), True)])).parquet(path)


def between(frame: DataFrame, start, end, *, back_s: int = 0, fwd_s: int = 0, at: str = "measureddtm") -> DataFrame:
    """Half-open time slice, widened by the slack; no lower bound where ``start`` is None.

    The bounds are literals on the stored column, so they reach the scan, and whole
    day folders are skipped where the table has them. A frame with a derived time is
    bounded on its stored time as well, a second wider.
    """
    until = epoch_of(end) + fwd_s
    conditions = []
    partitioned, derived = DAY_COLUMN in frame.columns, STORED_TIME in frame.columns
    if derived:
        conditions.append(f"{STORED_TIME} < timestamp_ntz '{_second(until + 1)}'")
    if partitioned:
        conditions.append(f"{DAY_COLUMN} <= date '{_day(until - 1)}'")
    if start is not None:
        since = epoch_of(start) - back_s
        if partitioned:
            conditions.append(f"{DAY_COLUMN} >= date '{_day(since)}'")
        if derived:
            conditions.append(f"{STORED_TIME} >= timestamp_ntz '{_second(since - 1)}'")
    # the derived time last: it is costly, and worked out for the rows that are left
    conditions.append(f"{at} < timestamp_seconds({until})")
    if start is not None:
        conditions.append(f"{at} >= timestamp_seconds({since})")
    return frame.where(" and ".join(conditions)).drop(STORED_TIME)


def _second(second: int) -> str:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=second)).isoformat(" ")


def _day(second: int) -> str:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=second)).date().isoformat()


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def read_fleet(spark: SparkSession, root: str) -> FleetTables:
    """All relations of a fleet stored under one root folder. Days and weeks are cut in session time, which must be UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"the session time zone is {zone}; set spark.sql.session.timeZone to UTC")
    return FleetTables(
        sensor=read_series(spark, f"{root}/sensor", schema.SENSOR),
        errors=read_series(spark, f"{root}/errors", schema.ERRORS),
        bad_time_errors=read_table(spark, f"{root}/bad_time_errors", schema.BAD_TIME_ERRORS),
        location_history=read_table(spark, f"{root}/location_history", schema.LOCATION_HISTORY),
        device=read_table(spark, f"{root}/device", schema.DEVICE),
        device_group=read_table(spark, f"{root}/device_group", schema.DEVICE_GROUP),
    )


SPLIT_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def read_sim_billing(spark: SparkSession, path: str | None = None, *, jdbc_url: str | None = None,
                     table: str = "sim_billing", options: dict[str, str] | None = None) -> DataFrame:
    """SIM billing history, kept outside the reports: a stored table or a federated one.

    A federated read must say how it is split, by the options partitionColumn, lowerBound, upperBound and
    numPartitions: without them one task would read the whole table.
    """
    if path is not None:
        return read_table(spark, path, schema.SIM_BILLING)
    if jdbc_url is None:
        raise ValueError("give a path or a jdbc_url")
    missing = [name for name in SPLIT_OPTIONS if name.lower() not in {given.lower() for given in options or {}}]
    if missing:
        raise ValueError(f"a federated read needs the options {', '.join(missing)}")
    remote = spark.read.format("jdbc").options(**options).option("url", jdbc_url)
    frame = remote.option("dbtable", table).load()
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.SIM_BILLING])


def readings(sensor: DataFrame, start, end, *columns: str) -> DataFrame:
    """Pruned window scan."""
    return between(sensor, start, end).select("fridgeid", "measureddtm", *columns)


def keyed_readings(sensor: DataFrame, start, end, *columns: str, back_s: int = 0, fwd_s: int = 0) -> DataFrame:
    """Window scan with ``epoch``, ``reading_id`` and ``inside``; slack rows lie outside the window."""
    inside = f"unix_seconds(measureddtm) >= {epoch_of(start)} and unix_seconds(measureddtm) < {epoch_of(end)}"
    return between(sensor, start, end, back_s=back_s, fwd_s=fwd_s).selectExpr(
        "fridgeid", "unix_seconds(measureddtm) as epoch", "reading_id", f"{inside} as inside", *columns)


def error_rows(errors: DataFrame, start, end, codes=None) -> DataFrame:
    rows = between(errors, start, end)
    return rows if codes is None else rows.where(F.col("id").isin(list(codes)))
