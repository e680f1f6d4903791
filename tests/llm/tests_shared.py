import math

import duckdb

TABLES = ["documents", "pages", "benchmark", "labels"]


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) and not math.isnan(v) else repr(v)


def same_as_sql(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel, columns = con.sql(sql), sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
