"""Sides of a join that are broadcast only after their size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100_000  # narrow rows: a few megabytes


def small_side(frame: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has at most ``most`` rows; counting stops beyond that. Otherwise Spark shuffles it."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame
