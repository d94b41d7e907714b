"""Runs a query and its DuckDB SQL on the same tables and compares rows, names and values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cur = connect(sf_dir).execute(sql)
    told = [d[0] for d in cur.description]
    assert sorted(told) == names, (sorted(told), names)
    order = [told.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (a, b)
    return len(mine)
