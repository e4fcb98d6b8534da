"""Row-multiset comparison of a Spark result with DuckDB's answer."""

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, list):
        return tuple(map(_plain, value))
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(row[name]) for name in names) for row in df.collect())


def duck_rows(con, sql):
    result = con.sql(sql)
    names = sorted(result.columns)
    order = [result.columns.index(name) for name in names]
    return names, Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
