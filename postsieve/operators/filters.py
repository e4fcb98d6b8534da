"""Row filters over postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import contains_terms
from .once import computed_once


def keyword_filter(df: DataFrame, query: str, columns: Sequence[str] = ("title", "jd")) -> DataFrame:
    """Postings whose text holds every blank-separated term of the query, whatever the case.

    The searched text is put together once per row, not once per term.
    """
    if not query.split():
        return df
    searched = computed_once(df, {"_searched": F.lower(F.concat_ws(" ", *columns))})
    return searched.filter(contains_terms(F.col("_searched"), query)).drop("_searched")
