"""Rows of Spark against rows of DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd

from quillgraph.sources.tables import BASE


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.execute(sql).df()


def plain(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return "null"
    try:
        return f"{float(x):.8g}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, [x for x in a if x not in set(b)][:3]
