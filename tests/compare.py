"""Rows of a query and of its SQL, in a form that can be compared."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (int, bool, str)) else str(v)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
