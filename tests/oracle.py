"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return c


def text(v) -> str:
    return "null" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)


def same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    got = sorted([text(v) for v in r] for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted([text(r[i]) for i in at] for r in want.fetchall())
