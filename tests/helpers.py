"""Small series of bars, and a comparison with SQL."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def series(spark, **columns):
    """One symbol's bars out of lists; a missing column is that of ``close``, or the first."""
    first = next(iter(columns.values()))
    close = columns.get("close", first)
    start = datetime(2024, 1, 1)
    rows = [
        ("a", i, start + timedelta(days=i), *[None if (v := columns.get(c, close)[i]) is None else float(v) for c in ("open", "high", "low", "close")])
        for i in range(len(first))
    ]
    extra = [c for c in columns if c not in ("open", "high", "low", "close")]
    rows = [(*r, *[columns[c][i] for c in extra]) for i, r in enumerate(rows)]
    kinds = ["int" if all(isinstance(v, int) for v in columns[c]) else "double" for c in extra]
    schema = "symbol string, bar_idx long, ts timestamp, open double, high double, low double, close double"
    return spark.createDataFrame(rows, ", ".join([schema, *[f"{c} {k}" for c, k in zip(extra, kinds, strict=True)]]))


def values(df, column):
    return [r[column] for r in df.orderBy("bar_idx").select(column).collect()]


def close_to(found, wanted):
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (found, wanted)


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, bool) or "bool" in type(v).__name__:
        return str(bool(v))
    return f"{float(v) + 0.0:.6g}"


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted("|".join(_cell(v) for v in r) for r in pdf.itertuples(index=False))


def by_sql(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(sql).fetchdf()
