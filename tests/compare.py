"""Run a registered query on Spark and its oracle on DuckDB, and compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from weftgraph.sources.views import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


SECONDS = {"spark": 0.0, "duck": 0.0}


def _plain(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}".replace("-0.000000", "0.000000")
    if isinstance(value, int):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat(" ")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql, sf_dir) -> str | None:
    """``None`` when equal, else a short account of the difference."""
    start = time.time()
    df = run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    SECONDS["spark"], start = time.time() - start, time.time()
    if sql is None:
        return None
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    SECONDS["duck"] = time.time() - start
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        a, b = set(got), set(want)
        return (f"{len(got)} rows against {len(want)}; only Spark {sorted(a - b)[:3]}; only oracle {sorted(b - a)[:3]}")
    return None if got else "no rows"


def main(argv: list[str]) -> int:
    sf_dir = argv[0]
    from weftgraph.plans import catalog
    from weftgraph.session import local_session

    runs, texts = catalog.load()
    chosen = [n for n in runs if not argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv[1:])]
    spark, con, bad = local_session(), duck(sf_dir), 0
    for name in chosen:
        try:
            problem = compare(spark, con, runs[name], texts.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        note = "" if name in texts else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{note} spark {SECONDS['spark']:.1f}s duck {SECONDS['duck']:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
