"""Run a query in Spark and its SQL in DuckDB and compare the rows as bags."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names, rows = duck(sql, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    a, b = rows_of(df.columns, got), rows_of(names, rows)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            same = u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-6))
            assert same, (x, y)
    return len(a)
