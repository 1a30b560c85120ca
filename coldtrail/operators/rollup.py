"""First, last, count and extreme event of each device and calendar bucket in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timebucket import bucket


def rollup(events: DataFrame, interval: str | None, *, keys: tuple[str, ...] = (), pick: Column | None = None,
           carry: tuple[str, ...] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """Roll events up to one row per device, ``keys`` and bucket.

    ``pick`` orders the events; the first one gives ``EventTime`` and the ``carry``
    columns (ties: earliest, then the carried values). Without it ``EventTime`` is
    the first event. ``FirstTime`` and ``LastTime`` span the bucket. All parts
    combine map-side, so one device may hold any share of the events.
    """
    at = F.col("EventTime")
    grouped = ["fridgeid", *keys]
    if interval is not None:
        events = events.withColumn("bucket", bucket(at, interval))
        grouped.append("bucket")
    parts = [F.count(F.lit(1)).cast("int").alias("RecCount"), F.min(at).alias("FirstTime"), F.max(at).alias("LastTime")]
    if carry or pick is not None:
        order = [] if pick is None else [pick.alias("_order")]
        parts.append(F.min(F.struct(*order, at, *carry)).alias("_first"))
    parts += [column.alias(name) for name, column in (extra or {}).items()]
    rolled = events.groupBy(*grouped).agg(*parts)
    if not carry and pick is None:
        return rolled.withColumn("EventTime", F.col("FirstTime"))
    picked = [F.col(f"_first.{name}").alias(name) for name in ("EventTime", *carry)]
    return rolled.select(*[c for c in rolled.columns if c != "_first"], *picked)
