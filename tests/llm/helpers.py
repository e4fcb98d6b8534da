"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashing columns."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def documents(sf_dir=SF):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
    return rows


def frame(spark, rows, parts=3):
    """doc_id, text, and columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return df.selectExpr(
        "doc_id", "text", "concat('s', doc_id % 3) AS source", "'x' AS size", "1 AS n", "2 AS _row", "3 AS node",
        "'y' AS score", "'z' AS spans", "4 AS target", "5 AS _key", "6 AS assign", "7 AS email", "8 AS doc", "9 AS ids",
    )


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def empty(spark):
    return frame(spark, [(1, "x")]).where(F.lit(False))
