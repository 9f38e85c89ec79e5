"""Run a query's SQL in DuckDB and compare results without regard to order."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, str):
        return x
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return int(x) if hasattr(x, "__int__") else x


def table(df: pd.DataFrame) -> list[tuple]:
    rows = [tuple(_plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, isinstance(v, str), v if v is not None else 0) for v in r))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(x, y) for x, y in zip(table(got), table(want)) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
