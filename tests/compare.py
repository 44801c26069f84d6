"""Run one registered query in Spark and its oracle in DuckDB and compare the rows as multisets."""

from __future__ import annotations

import collections
import math
import time

import duckdb

from veilspark.plans.base import TABLES


TIMES: dict[str, float] = {}


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "item"):
        return canon(v.item())
    return str(v)


def oracle(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def check(name, fn, sql, spark, sf, con):
    """None if equal, else a short text."""
    t = time.time()
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    TIMES["spark"] = time.time() - t
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"{name}: columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = collections.Counter(tuple(canon(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return None if got else f"{name}: both sides are empty"
    extra, lack = list((got - want).elements())[:2], list((want - got).elements())[:2]
    return f"{name}: {sum(got.values())} vs {sum(want.values())} rows; extra {extra}; missing {lack}"
