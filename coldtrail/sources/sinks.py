"""Report tables: rows in folders of their own, and a small manifest that says which of them make up the table.

A write goes to a new folder first and becomes part of the table when its line is
appended to the manifest, so that readers see the old rows or the new ones and a
failed write leaves the table as it was. The manifest also has the lowest and
highest event time of each folder, so that a reader opens only what can match.
One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import same_text

Window = dict[str, dt.date]
REPLACE, APPEND, CLEAR = "replace", "append", "clear"
_MANIFEST = "number long, action string, window string, folder string, rows long, low timestamp, high timestamp"


@dataclass(frozen=True)
class Part:
    """A folder of the table: its window and what is known of its rows."""

    window: str
    folder: str
    rows: int
    low: dt.datetime | None
    high: dt.datetime | None


def _name(window: Window) -> str:
    return "/".join(f"{name}={value.isoformat()}" for name, value in window.items())


def _lines(spark: SparkSession, path: str) -> list[T.Row]:
    try:
        lines = spark.read.schema(_MANIFEST).json(f"{path.rstrip('/')}/manifest").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = []
    return sorted(lines, key=lambda line: line["number"])


def parts(spark: SparkSession, path: str) -> list[Part]:
    """The folders that make up the table now, in the order they were added. The manifest has one line per write."""
    live: list[Part] = []
    for line in _lines(spark, path):
        if line["action"] == CLEAR:
            live = []
        elif line["action"] == REPLACE:
            live = [p for p in live if p.window != line["window"]]
        live.append(Part(line["window"], line["folder"], line["rows"], line["low"], line["high"]))
    return live


def publish(rows: DataFrame, path: str, window: Window, action: str, event_time: str | None = None) -> None:
    """Write the rows aside, then make them part of the table: beside its other rows, in place of the window's, or of all."""
    spark, root = rows.sparkSession, path.rstrip("/")
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    written = spark.read.schema(rows.schema).parquet(f"{root}/{folder}")
    span = [F.lit(None).cast("timestamp")] * 2 if event_time is None else [F.min(event_time), F.max(event_time)]
    count, low, high = written.agg(F.count(F.lit(1)), *[c.cast("timestamp").cast("string") for c in span]).first()
    number = max([line["number"] for line in _lines(spark, path)], default=0) + 1
    line = spark.range(1).select(
        F.lit(number).cast("long").alias("number"), F.lit(action).alias("action"), F.lit(_name(window)).alias("window"), F.lit(folder).alias("folder"),
        F.lit(count).cast("long").alias("rows"), F.lit(low).cast("timestamp").alias("low"), F.lit(high).cast("timestamp").alias("high"))
    line.coalesce(1).write.mode("append").json(f"{root}/manifest")


def read_parts(spark: SparkSession, path: str, struct: T.StructType, chosen: list[Part]) -> DataFrame:
    folders = [f"{path.rstrip('/')}/{part.folder}" for part in chosen if part.rows]
    stored = spark.read.schema(struct).parquet(*folders) if folders else spark.createDataFrame([], struct)
    return stored.select(*struct.names)


def read_report(spark: SparkSession, path: str, struct: T.StructType, window: Window | None = None) -> DataFrame:
    """The stored report, or one window of it; empty before the first run."""
    return read_parts(spark, path, struct, [p for p in parts(spark, path) if window is None or p.window == _name(window)])


def read_between(spark: SparkSession, path: str, struct: T.StructType, low: dt.datetime, high: dt.datetime, but: Window | None = None) -> DataFrame:
    """Rows with an event time from ``low`` to ``high``, without a window. Folders whose times lie outside stay shut; a row
    without a time is in no such span."""
    near = [p for p in parts(spark, path) if p.low is not None and p.low <= high and p.high >= low and (but is None or p.window != _name(but))]
    return read_parts(spark, path, struct, near).where(F.col("EventTime").between(F.lit(low), F.lit(high)))


def append_window(rows: DataFrame, path: str, window: Window, event_time: str | None = None) -> None:
    publish(rows, path, window, APPEND, event_time)


def replace_window(rows: DataFrame, path: str, window: Window, event_time: str | None = None) -> None:
    """The rows in place of the window's; no rows leave an empty window."""
    publish(rows, path, window, REPLACE, event_time)


def replace_report(rows: DataFrame, path: str, window: Window) -> None:
    publish(rows, path, window, CLEAR)


def unlisted_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of past or failed writes, which no reader that starts now will open."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/data")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    live = {p.folder for p in parts(spark, path)}
    found = [f"data/{status.getPath().getName()}" for status in files.listStatus(root)] if files.exists(root) else []
    return [folder for folder in found if folder not in live]


def remove_unlisted(spark: SparkSession, path: str) -> int:
    """Delete them; call it when nobody still reads an older state of the table."""
    gone = unlisted_folders(spark, path)
    for folder in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{folder}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)


def window_is_loaded(report: DataFrame, window: Window, country: str) -> bool:
    rows = report.where(same_text(F.col("Country"), country))
    for name, value in window.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return not rows.isEmpty()
