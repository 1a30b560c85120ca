"""Runs of consecutive buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebucket import boundary_diff, bucket


def bucket_islands(rows: DataFrame, interval: str = "Hour", at: str = "measureddtm") -> DataFrame:
    """Island number and length of each device's distinct buckets.

    The group flag of a bucket comes from the gap *behind* it, so the last bucket
    before a gap opens the next island. The windows see distinct buckets only: at
    most one row per hour of the report window.
    """
    buckets = rows.select("fridgeid", bucket(F.col(at), interval).alias("bucket")).distinct()
    in_order = Window.partitionBy("fridgeid").orderBy("bucket")
    gap = boundary_diff(interval.lower(), F.col("bucket"), F.lead("bucket").over(in_order))
    flagged = buckets.withColumn("gap", gap).withColumn(
        "opens", F.when(F.col("gap").isNull() | (F.col("gap") == 1), 0).otherwise(1))
    running = in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("island", F.sum("opens").over(running)).groupBy("fridgeid", "island").agg(
        F.count(F.lit(1)).alias("length"))
