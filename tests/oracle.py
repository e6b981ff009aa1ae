"""Compare a query's rows with DuckDB's over the same tables."""

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def duck_rows(sql, sf_dir=None, views=None):
    import duckdb

    con = duckdb.connect()
    if sf_dir:
        for t in TABLES:
            path = f"{sf_dir}/{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    for name, path in (views or {}).items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def same(df, sql, sf_dir=None, views=None):
    names, rows = duck_rows(sql, sf_dir, views)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
    return len(rows)
