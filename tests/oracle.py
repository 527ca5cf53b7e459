"""Runs a query and its SQL twin over one folder of tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
