"""The profile every posting is scored against."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row, one column `profile`: the whole text of the file, empty if there is no file."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.sql("SELECT '' AS profile")
    # an empty file yields no row at all
    several = F.raise_error(F.lit(f"more than one file in {path}"))
    text = F.coalesce(F.max("value"), F.lit(""))
    return files.agg(F.when(F.count("*") > 1, several).otherwise(text).alias("profile"))
