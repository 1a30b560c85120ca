"""Chart links of a device as plain string expressions over a configurable base address."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timebucket import epoch


@dataclass(frozen=True)
class LinkBase:
    device_mains: str = "https://charts.example.org/device/mains?fridgeid="
    device_solar: str = "https://charts.example.org/device/solar?fridgeid="
    errors_mains: str = "https://charts.example.org/errors/mains?fid="
    errors_solar: str = "https://charts.example.org/errors/solar?fid="


DEFAULT_BASE = LinkBase()
CODE_PARAMETER = "&var-ERRORS="


def _span(page: Column, fridgeid: Column, start: Column, end: Column, slack_s: int) -> Column:
    return F.concat(
        page, fridgeid.cast("string"),
        F.lit("&start="), (epoch(start) - slack_s).cast("string"),
        F.lit("&stop="), (epoch(end) + slack_s).cast("string"),
    )


def device_page(is_solar: Column, base: LinkBase = DEFAULT_BASE) -> Column:
    return F.when(is_solar, F.lit(base.device_solar)).otherwise(F.lit(base.device_mains))


def link_range(fridgeid: Column, is_solar: Column, start: Column, end: Column, slack_s: int,
               base: LinkBase = DEFAULT_BASE) -> Column:
    return _span(device_page(is_solar, base), fridgeid, start, end, slack_s)


def link_point(fridgeid: Column, is_solar: Column, at: Column, slack_s: int,
               base: LinkBase = DEFAULT_BASE) -> Column:
    return link_range(fridgeid, is_solar, at, at, slack_s, base)


def link_errors(fridgeid: Column, is_solar: Column, codes: Column, start: Column, end: Column,
                slack_s: int, base: LinkBase = DEFAULT_BASE) -> Column:
    """Error chart; ``codes`` is the ready suffix ``&var-ERRORS=...`` (repeatable)."""
    page = F.when(is_solar, F.lit(base.errors_solar)).otherwise(F.lit(base.errors_mains))
    return F.concat(_span(page, fridgeid, start, end, slack_s), codes)


def link_plain(fridgeid: Column, is_solar: Column, base: LinkBase = DEFAULT_BASE) -> Column:
    """Device page without a time range (older report layout)."""
    return F.concat(device_page(is_solar, base), fridgeid.cast("string"))
