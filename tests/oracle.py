"""Compare registered queries with their DuckDB text: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanwise.plans.fixtures import TABLES  # noqa: E402


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    """Return (ok, message)."""
    started = time.time()
    frame = query(spark, sf_dir)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    spark_s = time.time() - started
    n = sum(got.values())
    if sql is None:
        return n > 0, f"{name}: {n} rows (no oracle) {spark_s:.1f}s"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = _rows(cols, res.fetchall())
    if sorted(cols) != sorted(frame.columns):
        return False, f"{name}: columns {sorted(frame.columns)} != {sorted(cols)}"
    if got != want:
        a, b = got - want, want - got
        return False, (
            f"{name}: {sum(a.values())} rows only in Spark of {n}, {sum(b.values())} only in DuckDB of {sum(want.values())}\n"
            f"   columns {sorted(cols)}\n   spark  {list(a)[:3]}\n   duckdb {list(b)[:3]}"
        )
    return n > 0, f"{name}: {n} rows equal {spark_s:.1f}s"


def main():
    import __spark_entry__ as entry

    from spanwise.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for name in names:
        try:
            ok, message = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", message, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
