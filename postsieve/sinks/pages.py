"""A page table laid out so that a few pages are fetched without reading the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROW_GROUP_BYTES = 16 * 1024 * 1024


def write_pages(pages: DataFrame, path: str, mode: str = "append", row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write pages in order of `page_id`, in small row groups with a bloom filter of their ids.

    A fetch of some ids then opens the row groups whose range and filter hold one of them. Sorting moves each page once,
    when it is stored; `mode` "append" adds a delivery to those before it.
    """
    (
        pages.repartitionByRange("page_id")
        .sortWithinPartitions("page_id")
        .write.mode(mode)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.bloom.filter.enabled#page_id", "true")
        .parquet(path)
    )
