"""Run registered queries against their DuckDB twins: ``python tests/oracle_check.py [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ("rows-only" if got else "EMPTY"), len(got)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", len(got)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return (f"DIFF spark={len(got)} duck={len(want)} "
                f"only-spark={len(a)} {sorted(a)[:2]} only-duck={len(b)} {sorted(b)[:2]}"), len(got)
    return "ok", len(got)


if __name__ == "__main__":
    from quillspark.plans.catalog import all_queries
    from quillspark.session import local_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    session = local_session("oracle-check")
    duck = connect(sf)
    wanted = sys.argv[1:]
    bad = 0
    for name, (fn, sql) in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            status, n = compare(session, duck, sf, fn, sql)
        except Exception as exc:
            status, n = f"ERROR {type(exc).__name__}: {str(exc)[:600]}", -1
        bad += status not in ("ok", "rows-only")
        print(f"{name:32s} {n:7d} rows {time.time() - t0:6.2f}s  {status[:1200]}", flush=True)
    print("failures:", bad)
