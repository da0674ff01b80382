"""Runs a registered query and its SQL twin side by side and compares whole results."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    return str(bool(v)) if isinstance(v, (bool, np.bool_)) else v


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted; numbers as float, flags as text, missing values alike."""
    df = df[sorted(df.columns)].reset_index(drop=True)
    for c in df.columns:
        kind = df[c].dtype.kind
        if kind in "iuf":
            df[c] = df[c].astype("float64")
        elif kind == "M":
            df[c] = df[c].astype("datetime64[us]")
        else:
            values = [_plain(v) for v in df[c].astype(object)]
            numeric = any(isinstance(v, (int, float)) for v in values)
            df[c] = pd.Series(values, dtype="float64" if numeric else object)

    def text(v):
        return "" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)

    return df.sort_values(list(df.columns), kind="stable", key=lambda s: s.map(text)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            x, y = a[c].astype("float64"), b[c].astype("float64")
            bad = ~((x - y).abs().le(2e-6) | (x.isna() & y.isna()))
        else:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} values of {c}, first: {str(a.loc[i].to_dict())[:400]} vs {str(b.loc[i].to_dict())[:400]}"
    return None


def type_gap(spark_df, con, sql: str) -> str:
    """Column types that the two engines name differently (informational)."""
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    gaps = [f"{n}: {t} vs {want.get(n)}" for n, t in spark_df.dtypes if names.get(t) != want.get(n)]
    return "; ".join(gaps)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from riskframe.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in wanted or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = df.toPandas()
            middle = time.time()
            if name not in oracles:
                print(f"{name:28s} rows {len(got)} (no twin) {middle - start:.1f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            problem = compare(got, want)
            gap = type_gap(df, con, oracles[name])
        except Exception as error:  # noqa: BLE001
            problem, gap, middle, got = f"{type(error).__name__}: {str(error)[:500]}", "", time.time(), []
        print(f"{name:28s} {'ok  ' if not problem else 'FAIL'} rows {len(got)} {middle - start:.1f}s / {time.time() - middle:.1f}s  {problem or ''} {('TYPES ' + gap) if gap else ''}", flush=True)
        if problem:
            failed.append(name)
    print("FAILED", failed)
