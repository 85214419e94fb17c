"""Compare a query's rows with its DuckDB equivalent: same columns, same multiset of values."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(value(v) for v in x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if hasattr(x, "as_tuple"):
        return round(float(x), 6) + 0.0
    return x


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if (Path(sf_dir) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def expected(con, sql: str) -> tuple[list[str], Counter]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(value(r[i]) for i in order) for r in got.fetchall())


def actual(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(value(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def differences(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    names, rows = expected(con, sql)
    own_names, own = actual(df)
    if names != own_names:
        return f"columns {own_names} for {names}"
    more, less = own - rows, rows - own
    return "" if not more and not less else f"{sum(own.values())} rows for {sum(rows.values())}; extra {list(more)[:3]}; lacking {list(less)[:3]}"
