"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP", "date": "DATE",
             "boolean": "BOOLEAN"}


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def explained(frame) -> str:
    return frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, build, sql, folder):
    """Error text, or None; with row count and seconds."""
    began = time.time()
    frame = build(spark, folder)
    got = frame.collect()
    seconds = time.time() - began
    if sql is None:
        return None, len(got), seconds
    kinds = {row[0]: row[1] for row in con.execute(f"describe {sql}").fetchall()}
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}", len(got), seconds
    other = {f.name: (f.dataType.simpleString(), kinds[f.name]) for f in frame.schema
             if SQL_TYPES.get(f.dataType.simpleString()) != kinds[f.name]}
    if other:
        return f"types {other}", len(got), seconds
    a, b = rows_of(frame.columns, got), rows_of(columns, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"{len(a)} rows != {len(b)}; only spark {only_a}; only sql {only_b}", len(a), seconds
    return None, len(a), seconds


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{args.sf}"
    spark, con = session(), duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        try:
            error, count, seconds = compare(spark, con, name, queries[name], sql.get(name), folder)
        except Exception as failure:  # report and go on with the next query
            error, count, seconds = f"{type(failure).__name__}: {str(failure)[:1500]}", -1, 0.0
        bad += error is not None
        print(f"\n{'ok ' if error is None else 'BAD'} {name:36s} {count:7d} {seconds:6.2f}s {'' if name in sql else 'no sql'}", flush=True)
        if error:
            print("    ", error, flush=True)
    print(f"{len(args.names or queries)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
