"""Run a query and its SQL twin and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0  # no negative zero
    return v


def as_rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in records)


def compare(df, con, statement: str) -> list[str]:
    """What differs, as readable lines; nothing when the two agree."""
    got_cols, got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(statement)
    want_cols, want = as_rows([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    out = []
    if got != want:
        out.append(f"rows {sum(got.values())} against {sum(want.values())}")
        out += [f"  only here: {str(k)[:300]}" for k in list((got - want).keys())[:4]]
        out += [f"  only SQL:  {str(k)[:300]}" for k in list((want - got).keys())[:4]]
    kinds = {c: {type(v).__name__ for r in side for v in [r[i]] if v is not None} for side in (got, want) for i, c in enumerate(got_cols)}
    for i, c in enumerate(got_cols):
        a = {type(r[i]).__name__ for r in got if r[i] is not None}
        b = {type(r[i]).__name__ for r in want if r[i] is not None}
        if a and b and a != b:
            out.append(f"type of {c}: {a} against {b}")
    return out
