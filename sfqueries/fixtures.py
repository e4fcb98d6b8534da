"""Tables derived from the given ones, the same way in Spark and in DuckDB.

The given tables hold no postings, so pages stand in for them: events are sightings of pages,
template sentences carry the vocabulary, and answers are made from the event id. The text
constants below are plain SQL that both engines read alike.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.sources.tables import newest, read_table

PROFILE_TEXT = "python and java, spark spark"

LOCATION_SQL = """CASE event_id % 7 WHEN 0 THEN 'USA' WHEN 1 THEN 'india' WHEN 2 THEN 'Deutschland'
    WHEN 3 THEN 'SG' WHEN 4 THEN 'Dubai' WHEN 5 THEN 'Mars' ELSE ' us' END"""

EASY_APPLY_SQL = "event_id % 3 = 0"

TIMELINE_SQL = """CASE event_id % 6 WHEN 0 THEN '24H' WHEN 1 THEN '7D' WHEN 2 THEN '1W' WHEN 3 THEN '1M'
    WHEN 4 THEN '24h' ELSE '2W' END"""

SENTENCE_SQL = """CASE page_id % 5
    WHEN 0 THEN 'Minimum 3 years of experience with Java and Spring. US citizenship required.'
    WHEN 1 THEN '2-4 years of experience in Python, Django. No visa sponsorship is provided.'
    WHEN 2 THEN 'At least 5+ years working with Kubernetes and Docker. Active security clearance required.'
    WHEN 3 THEN 'Experience with React, HTML, CSS. Visa sponsorship available.'
    ELSE '1 to 2 years of Spark and Hadoop, data pipelines.' END"""

_OBJECT_SQL = """'{"company": "Acme, Inc", "min_exp": '
    || CASE event_id % 12 WHEN 0 THEN '3' WHEN 1 THEN '"N/A"' WHEN 2 THEN '""' WHEN 3 THEN 'null'
        WHEN 4 THEN '"2"' WHEN 5 THEN '"2+"' WHEN 6 THEN '2.7' ELSE '1' END
    || ', "max_exp": "N/A", "overall": "Java", "primary": "Java", "secondary": "SDE", "citizenship_required": '
    || CASE event_id % 12 WHEN 7 THEN 'true' WHEN 10 THEN 'null' ELSE 'false' END
    || ', "security_clearance_required": false, "visa_sponsorship": '
    || CASE event_id % 12 WHEN 8 THEN 'false' ELSE 'true' END || '}'"""

RESPONSE_SQL = f"""CASE event_id % 12
    WHEN 9 THEN '```json' || chr(10) || '{{broken' || chr(10) || '```'
    WHEN 11 THEN {_OBJECT_SQL}
    ELSE '```json' || chr(10) || {_OBJECT_SQL} || chr(10) || '```' END"""


_tables: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One DataFrame per table and application, so that files are listed once, not per use."""
    key = (spark.sparkContext.applicationId, sf_dir, name, spread)
    if key not in _tables:
        _tables[key] = read_table(spark, f"{sf_dir}/{name}.parquet", spread)
    return _tables[key]


def pages(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return table(spark, sf_dir, "pages", spread)


def postings_html(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """Pages with the template sentence put at the end of the article."""
    sentence = F.concat(F.lit(" "), F.expr(SENTENCE_SQL), F.lit("</article>"))
    return pages(spark, sf_dir, spread).withColumn("html", F.replace("html", F.lit("</article>"), sentence))


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The run's date: the newest sighting."""
    return newest(table(spark, sf_dir, "events"))


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


def sightings(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    count = row_count(spark, sf_dir, "pages")
    return table(spark, sf_dir, "events", spread).select(
        "event_id",
        "ts",
        (F.col("event_id") % count).alias("page_id"),
        F.expr(LOCATION_SQL).alias("location"),
        F.expr(EASY_APPLY_SQL).alias("easy_apply"),
    )


def answered(df: DataFrame) -> DataFrame:
    return df.withColumn("response", F.expr(RESPONSE_SQL))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def profile_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("vec_id = 0").select("embedding")


def profile_text(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT '{PROFILE_TEXT}' AS profile")


def page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, embedding): vectors are handed out to pages in turn."""
    count = row_count(spark, sf_dir, "embeddings")
    owners = pages(spark, sf_dir).select("page_id", (F.col("page_id") % count).alias("vec_id"))
    return owners.join(vectors(spark, sf_dir), "vec_id").select("page_id", "embedding")
