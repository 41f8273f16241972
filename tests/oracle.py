"""Runs a query and its SQL on the same tables and compares them as sets of rows."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
import numpy as np


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        path = f"{p}/*.parquet" if os.path.isdir(p) else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating)):
        return round(float(x), 6) + 0.0
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(_plain, x))
    if isinstance(x, datetime):
        return x.isoformat()
    return x


def rows(columns, values) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in values)


def difference(df, con, sql: str) -> str:
    """'' where equal, else what differs."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, cur.fetchall())
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
