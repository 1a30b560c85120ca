"""Shape of a detector finding and the device class it is meant for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import DEFAULT_BASE, LinkBase, link_errors, link_range

ENG_COLUMNS = ["fridgeid", "MessageInterval", "Message", "Detail", "value", "RecCount", "EventTime", "link", "Glink"]
TECH_COLUMNS = ["fridgeid", "Priority", "Message", "Detail", "value", "errCnt"]
DEVICE_LINK, ERROR_LINK, BOTH_LINKS = "device", "errors", "both"


def supported(interval: str, *known: str) -> str:
    """Canonical spelling of an interval; names are matched without case."""
    for name in known:
        if interval.lower() == name.lower():
            return name
    raise ValueError(f"interval {interval!r} is not supported here; use one of {', '.join(known)}")


def eng_columns(interval: str, message: Column | str, detail: Column | str | None, *,
                value: Column | None = None, count: Column | str = "RecCount", at: Column | str | None = "EventTime",
                span: tuple[Column | str, Column | str] = ("FirstTime", "LastTime"), slack_s: int,
                links: str = DEVICE_LINK, codes: Column | None = None, only: str | None = None) -> dict[str, Column]:
    """A finding's columns without its links: they need the device class, joined once by :func:`render`."""

    def col(x):
        return F.col(x) if isinstance(x, str) else x

    def text(x):
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    return {
        "MessageInterval": F.lit(interval), "Message": text(message), "Detail": text(detail), "value": text(value),
        "RecCount": col(count).cast("int"), "EventTime": col(at).cast("timestamp"), "link_from": col(span[0]), "link_to": col(span[1]),
        "link_slack": F.lit(slack_s), "link_kind": F.lit(links), "link_codes": text(codes), "only_class": F.lit(only).cast("string")}


def eng_rows(events: DataFrame, *args, **shape) -> DataFrame:
    """Findings of one shape, see :func:`eng_columns`."""
    return events.select("fridgeid", *[column.alias(name) for name, column in eng_columns(*args, **shape).items()])


def eng_cases(events: DataFrame, cases: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Findings whose columns depend on which condition a row meets."""
    def chosen(name: str) -> Column:
        (first, shape), *rest = cases
        chain = F.when(first, shape[name])
        for condition, other in rest:
            chain = chain.when(condition, other[name])
        return chain.alias(name)

    return events.select("fridgeid", *[chosen(name) for name in cases[0][1]])


def device_flags(device_group: DataFrame) -> DataFrame:
    """One row per grouped device with its class flags."""
    name = F.lower("GroupName")
    return device_group.groupBy("fridgeid").agg(
        F.max(name == "solar").alias("is_solar"), F.max(name == "freezer").alias("is_freezer"))


def with_class(rows: DataFrame, device_group: DataFrame) -> DataFrame:
    """Add ``is_solar``; devices in no group are mains devices."""
    flags = device_flags(device_group).select("fridgeid", "is_solar")
    return rows.join(flags, "fridgeid", "left").withColumn("is_solar", F.coalesce("is_solar", F.lit(False)))


def class_matches(is_solar: Column) -> Column:
    only = F.col("only_class")
    return only.isNull() | (only == F.when(is_solar, "S").otherwise("M"))


def render_classed(rows: DataFrame, base: LinkBase = DEFAULT_BASE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Gate findings that have ``is_solar`` by device class, and write their chart links."""
    classed = rows.where(class_matches(F.col("is_solar")))
    args = (F.col("fridgeid"), F.col("is_solar"))
    span = (F.col("link_from"), F.col("link_to"), F.col("link_slack"))
    kind = F.col("link_kind")
    device, errors = link_range(*args, *span, base), link_errors(*args, F.col("link_codes"), *span, base)
    return classed.select(
        *ENG_COLUMNS[:-2], *carry,
        F.when(kind == ERROR_LINK, errors).otherwise(device).alias("link"),
        F.when(kind == BOTH_LINKS, errors).alias("Glink"))


def render(rows: DataFrame, device_group: DataFrame, base: LinkBase = DEFAULT_BASE) -> DataFrame:
    return render_classed(with_class(rows, device_group), base)
