"""Compares a query with its SQL on the same files, independent of row order and of number types."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    for p in glob.glob(os.path.join(folder, "*.parquet")):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal",) or "int" in type(v).__name__ or "float" in type(v).__name__:
        return f"{round(float(v), 5) + 0.0:.5f}"
    return str(v).replace(" 00:00:00", "")


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, folder: str, query, sql: str) -> int:
    df = query(spark, folder)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = table([c[0] for c in cur.description], cur.fetchall())
    assert ours[0] == theirs[0], (ours[0], theirs[0])
    assert len(ours[1]) == len(theirs[1]), (len(ours[1]), len(theirs[1]))
    different = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    assert not different, different[:3]
    return len(ours[1])
