"""Compares queries with their SQL: ``python tests/oracle.py [scale] [name ...]``."""

from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 9))
    return str(value)


def canonical(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """A description of the first difference, if any."""
    df = query(spark, sf_dir)
    mine = canonical(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = canonical(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if mine == theirs:
        return None
    first = next((p for p in zip(mine, theirs) if p[0] != p[1]), None)
    return f"{len(mine)} / {len(theirs)} rows; first difference {first!r:.1500}"


def main() -> None:
    import __spark_entry__ as entry
    from threadloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="threadloom-"),
    }
    spark = build_session(master="local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                problem = None if queries[name](spark, sf_dir).collect() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {error}"[:1500]
        failed += problem is not None
        mark = "ok" if problem is None else "FAIL"
        print(f"{mark:5}{name:28}{time.time() - started:7.1f}s  {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
