"""Rows of a query against rows of its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 6) if isinstance(x, float) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


def same(df, sql, sf_dir):
    with connection(sf_dir) as c:
        result = c.execute(sql)
        names = [d[0] for d in result.description]
        want = rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == want
