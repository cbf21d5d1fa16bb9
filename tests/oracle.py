"""Run registered queries next to their SQL in DuckDB and compare the results.

    python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(v):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        return tuple(normal(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(normal(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """(rows, problem or None)"""
    df = fn(spark, sf_dir)
    names, got = rows_of(df.columns, df.collect())
    total = sum(got.values())
    if sql is None:
        return total, None
    cur = con.execute(sql)
    oracle_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != oracle_names:
        return total, f"columns {names} != {oracle_names}"
    if got != want:
        extra, absent = got - want, want - got
        return total, f"{sum(extra.values())} extra, {sum(absent.values())} absent: {list(extra)[:2]} vs {list(absent)[:2]}"
    for a, b in zip(sorted(got, key=str)[:50], sorted(want, key=str)[:50], strict=False):
        kinds = [(type(x).__name__, type(y).__name__) for x, y in zip(a, b, strict=True) if x is not None and y is not None and type(x) is not type(y)]
        if kinds:
            return total, f"types differ: {kinds[:3]}"
    return total, None


def make_spark():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


if __name__ == "__main__":
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark = make_spark()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            n, problem = compare(spark, con, sf_dir, fn, sql.get(name))
        except Exception as ex:
            n, problem = -1, f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += problem is not None
        mark = "FAIL" if problem else "ok" if name in sql else "rows"
        print(f"{mark:5} {name:28} {n:8} {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print("failed:", bad)
