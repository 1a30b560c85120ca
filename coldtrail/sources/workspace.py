"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, list[str]] = {}  # folders by application


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, else under the warehouse; the same rule for every master. A warehouse on the
    machine's own disk is refused where executors run elsewhere: they would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = warehouse.rstrip("/") + "/_scratch"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it ends: its rows are stored then."""
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: later jobs neither recompute them nor depend on an executor."""
    spark, folder = frame.sparkSession, shared_folder(frame.sparkSession, name)
    with _shuffles_freed(spark):
        frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def clear_stored(spark: SparkSession) -> int:
    """Delete the folders this application has made so far, for callers whose results are written; returns how many."""
    folders = _made.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)
