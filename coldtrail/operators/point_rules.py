"""Rules over single readings, any number of them in one scan and one roll-up.

A reading becomes an array with an entry for each rule it meets; the entries are
inlined and rolled up by (device, rule, key, bucket). All parts of the aggregate
have a fixed width, extremes with the time and detail they carry included, so that
it runs by hash and combines in the map tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.orderkey import bits_of, detail_of, packed_rank, rank_of, time_of, turned_rank
from ..functions.timebucket import bucket, week_label
from ..sources.tables import FleetTables, readings
from .findings import eng_cases

AT = "measureddtm"


@dataclass(frozen=True)
class Match:
    """One way to meet a rule: the condition, the value it reports, a key that rolls up apart, and the number of its detail."""

    condition: Column
    value: Column | None = None
    key: Column | None = None
    detail: int = 0


LOWEST, HIGHEST, BY_KEY = "lowest", "highest", "by key"


@dataclass(frozen=True)
class PointRule:
    """``shape`` gives the finding's columns (see ``findings.eng_columns``) and ``keep`` which rolled rows are findings.

    ``interval`` is the bucket, None for single events. ``pick`` names the picked event:
    the lowest, the highest, or by key (0 the highest, 1 the lowest); ties go to the
    earliest, then the smaller detail. ``both_ends`` keeps the time of the lowest as
    well; ``counted`` are conditions on ``value`` that are counted beside all events.
    ``weekly`` buckets are summed up to weeks, ``full`` is a condition on their
    RecCount that is counted. ``keep`` names counts and sums, not the picked event.
    """

    number: int
    columns: tuple[str, ...]
    matches: tuple[Match, ...]
    interval: str | None
    shape: Callable[[], dict[str, Column]]
    pick: str | None = None
    both_ends: bool = False
    counted: tuple[Column, Column] | None = None
    keep: Column | None = None
    weekly: bool = False
    full: Column | None = None
    solar: bool = False
    per_device: tuple[int, ...] = field(default=())  # numbers of rules that sum this one's values up by device


def _entries(frame: DataFrame, start, end, rules: Sequence[PointRule]) -> DataFrame:
    columns = list(dict.fromkeys(c for rule in rules for c in rule.columns))
    null = F.lit(None)
    entries, conditions = [], []
    for rule in rules:
        for match in rule.matches:
            conditions.append(match.condition)
            entries.append(F.when(match.condition, F.struct(
                F.lit(rule.number).alias("rule"), (F.lit(0) if match.key is None else match.key.cast("int")).alias("key"),
                (null if match.value is None else match.value).cast("double").alias("value"), F.lit(match.detail).alias("detail"),
                (null.cast("timestamp") if rule.interval is None else bucket(F.col(AT), rule.interval).cast("timestamp")).alias("bucket"))))
    rows = readings(frame, start, end, *columns).where(reduce(lambda a, b: a | b, conditions))
    return rows.select("fridgeid", F.col(AT).alias("EventTime"), F.inline(F.array(*entries))).where("rule is not null")


def _tables(t: FleetTables, start, end, rules: Sequence[PointRule]) -> DataFrame:
    """Entries of all rules: one scan, or two where solar devices have a table of their own."""
    if t.solar_sensor is t.sensor:
        return _entries(t.sensor, start, end, rules)
    parts = [(t.sensor, [r for r in rules if not r.solar]), (t.solar_sensor, [r for r in rules if r.solar])]
    return reduce(DataFrame.unionByName, [_entries(frame, start, end, some) for frame, some in parts if some])


def _by_rule(rules: Sequence[PointRule], column: Callable[[PointRule], Column | None]) -> Column:
    """The column of the row's own rule; null where it has none."""
    chain = F.when(F.lit(False), None)
    for rule in rules:
        own = column(rule)
        if own is not None:
            chain = chain.when(F.col("rule") == rule.number, own)
    return chain


def _turned(rule: PointRule) -> Column:
    """Whether the event is picked by the negative of its value."""
    return F.lit(rule.pick == HIGHEST) if rule.pick != BY_KEY else F.col("key") == 0


def _rolled(entries: DataFrame, rules: Sequence[PointRule]) -> DataFrame:
    at = F.col("EventTime")
    value = F.col("value")
    pick = _by_rule(rules, lambda r: None if r.pick is None else F.when(_turned(r), -value).otherwise(value)).cast("double")
    # each in a projection of its own, so that the bits are read once
    ranked = entries.withColumn("pick", pick).withColumn("bits", bits_of(F.col("pick"))).withColumn("rank", rank_of(F.col("bits")))
    low_rank = _by_rule(rules, lambda r: F.when(_turned(r), turned_rank(F.col("rank"), F.col("pick"))).otherwise(F.col("rank")) if r.both_ends else None)
    rows = ranked.withColumns({
        "best": packed_rank(F.col("rank"), at, F.col("detail")),
        "lowest": packed_rank(low_rank.cast("bigint"), at),
        "is_low": _by_rule(rules, lambda r: r.counted[0] if r.counted else None).cast("boolean"),
        "is_high": _by_rule(rules, lambda r: r.counted[1] if r.counted else None).cast("boolean")})
    rolled = rows.groupBy("fridgeid", "rule", "key", "bucket").agg(
        F.count(F.lit(1)).alias("RecCount"), F.min(at).alias("FirstTime"), F.max(at).alias("LastTime"), F.min(F.col("pick") + F.lit(0.0)).alias("found"), F.min("best").alias("best"), F.min("lowest").alias("lowest"),
        F.count_if("is_low").alias("low_count"), F.count_if("is_high").alias("high_count"), F.sum("value").alias("total"))
    if not any(r.weekly or r.per_device for r in rules):
        return rolled.withColumn("full", F.lit(0).cast("bigint"))
    # second level, over few rows: hours to weeks, and sums by device beside the hours they come from
    rolled = rolled.withColumn("full", _by_rule(rules, lambda r: r.full).cast("boolean"))
    rolled = rolled.withColumn("bucket", F.coalesce(_by_rule(rules, lambda r: week_label(F.col("bucket")) if r.weekly else None).cast("timestamp"), "bucket"))
    here = F.struct("rule", "bucket")
    also = _by_rule(rules, lambda r: F.array(here, *[F.struct(F.lit(n).alias("rule"), F.lit(None).cast("timestamp").alias("bucket")) for n in r.per_device]) if r.per_device else None)
    spread = rolled.withColumn("to", F.coalesce(also, F.array(here))).drop("rule", "bucket").select("*", F.inline("to")).drop("to")
    return spread.groupBy("fridgeid", "rule", "key", "bucket").agg(
        F.sum("RecCount").alias("RecCount"), F.min("FirstTime").alias("FirstTime"), F.max("LastTime").alias("LastTime"), F.min("found").alias("found"), F.min("best").alias("best"), F.min("lowest").alias("lowest"),
        F.sum("low_count").alias("low_count"), F.sum("high_count").alias("high_count"), F.sum("total").alias("total"), F.count_if("full").alias("full"))


def point_rows(t: FleetTables, start, end, rules: Sequence[PointRule], extra: DataFrame | None = None) -> DataFrame:
    """Findings of all the rules, unrendered. ``extra`` (fridgeid, rule, ...) adds columns to rolled rows of a device and rule.

    Rolled rows have the columns RecCount, FirstTime, LastTime, EventTime, value and
    detail of the picked event (of the first one without a pick), LowTime, low_count,
    high_count, total and full.
    """
    parts = []
    single = [r for r in rules if r.interval is None]
    if single:
        events = _tables(t, start, end, single)
        parts.append(eng_cases(events, [(F.col("rule") == r.number, r.shape()) for r in single]))
    several = [r for r in rules if r.interval is not None]
    if several:
        rolled = _rolled(_tables(t, start, end, [r for r in several if r.matches]), several)
        if extra is not None:
            rolled = rolled.join(extra, ["fridgeid", "rule"], "left")
        # before the picked events are decoded
        rolled = rolled.where(F.coalesce(_by_rule(several, lambda r: F.lit(True) if r.keep is None else r.keep).cast("boolean"), F.lit(False)))
        found = F.col("found")
        turned = _by_rule(several, lambda r: _turned(r) if r.pick else None).cast("boolean")
        rows = rolled.withColumns({
            "EventTime": F.coalesce(time_of(F.col("best")), "FirstTime"), "value": F.when(turned, -found).otherwise(found), "detail": detail_of(F.col("best")),
            "LowTime": time_of(F.col("lowest"))})
        parts.append(eng_cases(rows, [(F.col("rule") == r.number, r.shape()) for r in several]))
    return reduce(DataFrame.unionByName, parts)
