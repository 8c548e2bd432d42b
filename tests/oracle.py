"""Runs a query on both engines and compares the rows."""

import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        path = os.path.join(folder, f)
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def differences(query, sql, spark, con, folder):
    df, other = query(spark, folder), con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(other.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(names).collect())
    theirs = sorted(tuple(map(plain, r)) for r in other.select(*(duckdb.ColumnExpression(n) for n in names)).fetchall())
    return None if ours == theirs else (len(ours), len(theirs), [x for x in ours if x not in theirs][:2], [x for x in theirs if x not in ours][:2])
