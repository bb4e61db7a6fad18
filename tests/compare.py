"""Compares a query with its SQL, row by row."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        own = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{own}'")
    return con


def key(row: tuple) -> tuple:
    return tuple((x is None, str(type(x)), round(x, 3) if isinstance(x, float) else x if x is not None else 0) for x in row)


def differences(frame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark result and that of SQL, columns by name and rows in any order."""
    names = sorted(frame.columns)
    got = [tuple(r[c] for c in names) for r in frame.collect()]
    result = con.execute(sql)
    have = [d[0] for d in result.description]
    if sorted(have) != names:
        return [f"columns {names} and {sorted(have)}"]
    place = [have.index(c) for c in names]
    want = [tuple(r[i] for i in place) for r in result.fetchall()]
    if len(got) != len(want):
        return [f"{len(got)} rows and {len(want)}"]
    out = []
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, (int, float)):
                if not math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4):
                    out.append(f"{a} and {b}")
                    break
            elif x != y:
                out.append(f"{a} and {b}")
                break
    return out
