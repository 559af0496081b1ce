"""Compare registered queries with their SQL, run by DuckDB on the same files."""

from __future__ import annotations

import glob
import math
import os
from datetime import datetime

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple((type(r[i]).__name__, _cell(r[i])) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None if the query and the SQL give the same columns and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want, got = canonical(names, result.fetchall()), canonical(df.columns, df.collect())
    if len(want) != len(got):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(oracle_sql())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name in wanted:
        start = time.time()
        try:
            message = differences(queries()[name](spark, sf_dir), con, sqls[name])
        except Exception as e:
            message = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += message is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {message or 'ok'}", flush=True)
    print(f"{failed} of {len(wanted)} failed")
