"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet") or glob.glob(f"{sf_dir}/{t}.parquet/*"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else x
    if hasattr(x, "replace") and hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


def difference(df, sql: str, con) -> str:
    """What differs: columns, types, number of rows or values; empty if nothing does."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in theirs), key=repr)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    kinds = dict(zip(names, (str(x[1]) for x in con.execute(sql).description), strict=True))
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    bad = {c: (t, described.get(c, kinds[c])) for c, t in df.dtypes if not described.get(c, "").startswith(types.get(t, "?"))}
    if bad:
        return f"types {bad}"
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(wrong)} of {len(ours)} rows, such as {order}: {wrong[0]}" if wrong else ""
