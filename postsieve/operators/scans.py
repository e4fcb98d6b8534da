"""Scan membership: which scans list a sighting, in one pass over the sightings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.predicates import window_end, window_start
from .ordering import listed_pages, newest_first

Scans = Sequence[tuple[str, int]]


def union_scans(sightings: DataFrame, scans: Scans, as_of: datetime | None) -> DataFrame:
    """Every sighting once per scan whose window it falls into, with `scan_rank` and `scan`.

    The same rows as a union of one filtered read per scan, from a single read: the windows
    overlap, so reading per scan would read the recent part several times over.
    """
    return _listed_by(within_widest(sightings, scans, as_of), scans, as_of, row_limits=False)


def top_scans(
    sightings: DataFrame, scans: Scans, as_of: datetime | None, page_size: int = dims.PAGE_SIZE, first_rank: int = 0
) -> DataFrame:
    """Like `union_scans`, but every scan shows only its first pages, and rows carry
    `page` and `position`.

    Windows nest and the order is newest first, so each scan's list is a prefix of the widest
    scan's list: one top-k over the widest window serves all of them.
    """
    inside = within_widest(sightings, scans, as_of)
    order = newest_first()
    top = listed_pages(inside, order, F.col("ts"), max(pages for _, pages in scans), page_size)
    listed = _listed_by(top, scans, as_of, row_limits=True)
    return listed.withColumn("scan_rank", F.col("scan_rank") + first_rank)


def within_widest(sightings: DataFrame, scans: Scans, as_of: datetime | None) -> DataFrame:
    """Sightings that at least one of the scans can list: those inside the widest window.

    No window reaches beyond `as_of`, so a run for an earlier time lists what it would have then.
    """
    if as_of is not None:
        sightings = sightings.filter(F.col("ts") <= window_end(as_of))
    seconds = {timeline: dims.TIMELINE_SECONDS.get(timeline) for timeline, _ in scans}
    if None in seconds.values():
        return sightings
    return sightings.filter(F.col("ts") >= window_start(max(seconds, key=seconds.get), as_of))


def _listed_by(df: DataFrame, scans: Scans, as_of: datetime | None, row_limits: bool) -> DataFrame:
    entries = []
    for rank, (timeline, pages) in enumerate(scans):
        start = window_start(timeline, as_of)
        inside = F.lit(True) if start is None else F.col("ts") >= start
        if row_limits:
            inside = inside & (F.col("page") < pages)
        entry = F.struct(F.lit(rank).alias("scan_rank"), F.lit(timeline).alias("scan"))
        entries.append(F.when(inside, entry))
    return (
        df.withColumn("_scan", F.explode(F.array_compact(F.array(*entries))))
        .select(*df.columns, "_scan.scan_rank", "_scan.scan")
    )
