"""Comparison of a query's rows with its SQL's, in any order."""

import os
from collections import Counter

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return v


def bag(rows, columns):
    return Counter(tuple(plain(r[i]) for i in columns) for r in rows)


def same(df, con, sql):
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    ours = bag(df.collect(), [df.columns.index(c) for c in cols])
    theirs = bag(cur.fetchall(), [names.index(c) for c in cols])
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
