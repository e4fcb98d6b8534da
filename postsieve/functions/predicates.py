"""The filters of the three commands as boolean columns."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .response import experience_unstated


def window_start(timeline: str, as_of: datetime | None) -> Column | None:
    """Oldest timestamp of a timeline window; None if the code sets no window.

    The bound is a constant, so a comparison with it reaches the file scan as a pushed filter
    and prunes row groups. `sources.tables.newest` reads a table's newest timestamp.
    """
    seconds = dims.TIMELINE_SECONDS.get(timeline)
    if seconds is None:
        return None
    # by way of text, so that no Python or session time zone gets between
    start = None if as_of is None else (as_of - timedelta(seconds=seconds)).isoformat(sep=" ")
    return F.lit(start).cast("timestamp_ntz")


def window_end(as_of: datetime | None) -> Column | None:
    """Newest timestamp of every window: the time looked back from, as a constant."""
    return None if as_of is None else F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def within_window(ts: Column, timeline: str, as_of: datetime | None) -> Column:
    start, end = window_start(timeline, as_of), window_end(as_of)
    inside = F.lit(True) if start is None else ts >= start
    return inside if end is None else inside & (ts <= end)


def matches_keywords(text: Column, query: str) -> Column:
    """Every blank-separated term of the query occurs in the text, whatever the case."""
    return contains_terms(F.lower(text), query)


def contains_terms(lowered: Column, query: str) -> Column:
    terms = (F.contains(lowered, F.lit(term)) for term in query.lower().split())
    return reduce(Column.__and__, terms, F.lit(True))


def experience_bound(raw: Column, years: Column, limit: int) -> Column:
    """Experience not stated, or at most `limit` years."""
    return experience_unstated(raw) | (years <= F.lit(limit))


def suitable(
    limit: int = 3,
    citizenship_required: bool = False,
    security_clearance_required: bool = False,
    visa_sponsorship: bool = True,
) -> Column:
    """Experience within bounds and all three flags equal to what is wanted.

    Plain equality: an unknown flag is neither, and the row is filtered out.
    """
    return (
        experience_bound(F.col("min_exp"), F.col("min_exp_years"), limit)
        & (F.col("citizenship_required") == F.lit(citizenship_required))
        & (F.col("security_clearance_required") == F.lit(security_clearance_required))
        & (F.col("visa_sponsorship") == F.lit(visa_sponsorship))
    )


def age_match(min_years: Column, max_years: Column, low: float = 1.5, high: float = 2.0) -> Column:
    """True unless the stated experience range misses [low, high]; an open end is unbounded."""
    return min_years.isNull() | ((min_years <= F.lit(high)) & (F.coalesce(max_years, F.lit(1e9)) >= F.lit(low)))
