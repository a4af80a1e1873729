"""Runs a query and the SQL that shall give the same rows, and compares them."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p / 'part-*.parquet' if p.is_dir() else p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if the rows are the same."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, want.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] == b[1]:
        return ""
    only = [x for x in a[1] if x not in set(b[1])][:2], [x for x in b[1] if x not in set(a[1])][:2]
    return f"{len(a[1])} and {len(b[1])} rows; {only}"[:1500]
