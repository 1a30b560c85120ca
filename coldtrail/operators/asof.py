"""As-of pairs in time: the next reading a fixed time later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebucket import boundary_diff, epoch_of
from ..limits import Limits
from ..sources.tables import keyed_readings


def next_day_pairs(sensor: DataFrame, start, end, limits: Limits = Limits(), chunk_s: int | None = None) -> DataFrame:
    """Each reading with the first one at least ``drain_after_s`` later, both with a charge.

    Pairs ``drain_minutes`` or more apart are dropped, which bounds the search: a
    probe placed at the due time and the readings of the following hour meet in one
    (device, chunk), where a running last-value from the latest time backwards gives
    the partner in linear time.
    """
    after = limits.drain_after_s
    reach = limits.drain_minutes * 60 - after
    chunk_s = chunk_s or max(2 * reach, 600)
    rows = keyed_readings(sensor, start, end, "ECDBAT")
    at, due = F.col("epoch"), F.col("epoch") + after

    def entry(kind: int, key, chunk):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), chunk.alias("chunk"))

    targets = F.transform(
        F.sequence(F.floor((at - reach) / chunk_s), F.floor(at / chunk_s)), lambda c: entry(0, at, c))
    has_probe = F.col("ECDBAT").isNotNull() & (due < epoch_of(end))
    probe = F.array(entry(1, due, F.floor(due / chunk_s)))
    placed = rows.select("fridgeid", "epoch", "reading_id", "ECDBAT",
                         F.inline(F.when(has_probe, F.concat(targets, probe)).otherwise(targets)))
    backwards = (
        Window.partitionBy("fridgeid", "chunk")
        .orderBy(F.desc("key"), F.asc("kind"), F.desc("reading_id"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(F.col("kind") == 0, F.struct(F.col("epoch").alias("at"), F.col("ECDBAT").alias("charge")))
    met = placed.withColumn("next", F.last(target, ignorenulls=True).over(backwards)).where(
        (F.col("kind") == 1) & F.col("next.charge").isNotNull())
    pairs = met.select(
        "fridgeid",
        F.timestamp_seconds("epoch").alias("startDtm"), F.timestamp_seconds("next.at").alias("endDtm"),
        F.col("ECDBAT").alias("battStart"), F.col("next.charge").alias("battEnd"),
        (F.col("next.charge") - F.col("ECDBAT")).alias("battDiff"))
    return pairs.where(boundary_diff("minute", F.col("startDtm"), F.col("endDtm")) < limits.drain_minutes)

