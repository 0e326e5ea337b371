"""Comparing a query with its SQL, row by row."""

from __future__ import annotations

import os
from collections import Counter

import duckdb


def connect(sf: str):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return f"{v:.9g}"
    return v


def compare(spark, sf: str, query, sql: str) -> int:
    df = query(spark, sf)
    names = sorted(df.columns)
    ours = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    q = connect(sf).execute(sql)
    cols = [d[0] for d in q.description]
    assert sorted(cols) == names
    at = [cols.index(n) for n in names]
    theirs = [tuple(plain(r[i]) for i in at) for r in q.fetchall()]
    a, b = Counter(map(repr, ours)), Counter(map(repr, theirs))
    assert a == b, (list((a - b))[:2], list((b - a))[:2])
    return len(ours)
