"""Running a query beside its SQL on the same tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pandas as pd

DATA = Path(os.environ.get("PAIRLOOM_TESTDATA", "/root/testdata/sf0.001"))


def connect():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def cell(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return f"{x:.6g}".removesuffix(".0")
    return str(x)


def table(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


def same(spark, query, sql: str) -> None:
    got, want = query(spark, str(DATA)).toPandas(), connect().execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
