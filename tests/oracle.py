"""Compare a registered query with its SQL statement on DuckDB, as multisets of rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from attesta.queries import registry
from attesta.session import TABLES, build_session

registry.load_all()
TIMES: dict[str, float] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(rows, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    t0 = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES[name] = time.time() - t0
    if name not in registry.SQL:
        return f"rows-only {len(got)}" if got else "FAIL: no rows"
    cur = con.execute(registry.SQL[name])
    ecols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ecols:
        return f"FAIL: columns {cols} vs {ecols}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return f"FAIL: rows {len(got)} vs {len(want)}; spark only {only_got}; sql only {only_want}"
    return f"ok {len(got)}" if got else "ok but empty"


if __name__ == "__main__":
    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in sys.argv[2:] or list(registry.QUERIES):
        t = time.time()
        try:
            res = compare(spark, con, name, sf)
        except Exception as e:  # noqa: BLE001
            res = "FAIL: " + str(e)[:1500]
        print(f"{name:32s} {TIMES.get(name, 0):6.1f}s of {time.time() - t:6.1f}s {res[:2500]}", flush=True)
