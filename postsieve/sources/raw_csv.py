"""Posting files without a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_raw_postings(spark: SparkSession, paths: str | list[str], layout: str = "raw_v2") -> DataFrame:
    """Rows of one or more files in a stated layout; files are concatenated, repeats kept.

    A row with too many or unreadable values keeps its line in `_corrupt_record`. Whole lines are
    parsed whatever columns a query asks for: otherwise the same row could pass in one query and
    be corrupt in another.
    """
    return (
        spark.read.schema(schemas.layout(layout, corrupt=True))
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .option("escape", '"')
        .csv(paths)
    )


def read_digest(spark: SparkSession, paths: str | list[str], with_score: bool = False) -> DataFrame:
    """Rows of written digests (these have a header)."""
    schema = schemas.layout("digest")
    if with_score:
        schema = schema.add("match_score", schemas.column_type("match_score"))
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(paths)


def misfits() -> Column:
    """True for rows that do not fit the layout. Mentions a value column as well, because Spark
    refuses queries over nothing but the corrupt-record column."""
    return F.col(schemas.CORRUPT).isNotNull() & (F.coalesce(F.length("link"), F.lit(0)) >= 0)
