"""Compares a query with its SQL in DuckDB."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf=SF):
    d = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return d


def plain(v):
    return repr(v) if isinstance(v, float) else str(v)


def same(spark, query, sql, sf=SF):
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    found = connection(sf).execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert got == want
