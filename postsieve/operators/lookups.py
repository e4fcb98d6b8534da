"""Lookups against the fixed tables, and against what earlier runs have seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims


def with_geo_id(df: DataFrame, location: str = "location") -> DataFrame:
    """Add `geo_id`: alias match in lower case, the default for everything else.

    The alias table is a constant of twenty rows, so broadcasting it is always safe and the
    big side never moves.
    """
    aliases = F.broadcast(dims.geo_alias(df.sparkSession))
    return (
        df.join(aliases, F.lower(df[location]) == aliases["alias"], "left")
        .withColumn("geo_id", F.coalesce("geo_id", F.lit(dims.DEFAULT_GEO_ID)))
        .drop("alias")
    )


def with_timeline_seconds(df: DataFrame, code: str = "code") -> DataFrame:
    """Add `seconds`, null for codes that set no window. The table is a constant of four rows."""
    windows = dims.timeline(df.sparkSession).withColumnRenamed("code", "_code")
    return df.join(F.broadcast(windows), df[code] == F.col("_code"), "left").drop("_code")


def new_since(df: DataFrame, previous: DataFrame, key: str = "link") -> DataFrame:
    """Rows whose key no earlier run has seen.

    Both sides grow with the data, so there is no broadcast hint. Earlier keys are reduced to
    one row each before they are shuffled; a hot key on the left is left to skew-join
    splitting, which an anti join allows on that side. Call it after `ordering.first_seen` and
    the left side has one row per key anyway.
    """
    seen = previous.select(key).filter(F.col(key).isNotNull()).distinct()
    return df.join(seen, key, "left_anti")
