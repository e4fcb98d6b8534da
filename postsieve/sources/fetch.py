"""Wide rows of a few ids, read through a filter that reaches the files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids written into a filter. The list goes to the driver, so this bounds what is collected.
LISTED_IDS = 2_000


def by_ids(table: DataFrame, ids: DataFrame, key: str, listed: int = LISTED_IDS) -> DataFrame:
    """Rows of `table` whose `key` is among those of `ids`, which is a settled, narrow table. Null ids find nothing.

    Up to `listed` different ids become a constant list: a pushed filter by which row groups are left out
    (`sinks.pages.write_pages` makes tables where most are). Above it the bounds of the ids are pushed,
    and a semi join takes the rows, before which Spark filters by a bloom filter where the table is large.
    """
    wanted = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    values = [row[0] for row in wanted.limit(listed + 1).collect()]
    if len(values) <= listed:
        return by_list(table, values, key)
    low, high = ids.agg(F.min(key), F.max(key)).first()
    return table.filter(F.col(key).between(low, high)).join(wanted, key, "left_semi")


def by_list(table: DataFrame, values: Iterable, key: str) -> DataFrame:
    """Rows of `table` whose `key` is among some values that are few; null is not looked for."""
    values = sorted({value for value in values if value is not None})
    return table.filter(F.col(key).isin(values)) if values else table.filter(F.lit(False))
