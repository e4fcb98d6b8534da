"""Writing records, digests and rejected rows."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import flag_text


def append_raw(df: DataFrame, path: str, layout: str = "raw_v2", partition_by: Sequence[str] = ()) -> None:
    """Append records to a folder of header-less CSV files, in the column order of a layout.

    Running twice adds the rows twice; `operators.lookups.new_since` keeps repeats out.
    `partition_by` names further columns (say geo_id, timeline, easy_apply) that become folders.
    """
    values = [
        flag_text(F.col(name)).alias(name) if schemas.column_type(name).typeName() == "boolean" else F.col(name)
        for name in schemas.LAYOUTS[layout]
    ]
    writer = df.select(*values, *partition_by).write.mode("append").option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_digest(df: DataFrame, targets: str | Sequence[str], single_file: bool = False) -> None:
    """Write a digest with a header to every target.

    Files per target follow the partitions of `df`. `single_file` is for page-limited digests
    only: it brings all rows into one task.
    """
    targets = [targets] if isinstance(targets, str) else list(targets)
    rows = df.coalesce(1) if single_file else df
    with _kept(rows, uses=len(targets)):
        for target in targets:
            rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(target)


def write_split(
    df: DataFrame, good_path: str, quarantine_path: str, layout: str = "raw_v2", reason: str = "reason"
) -> None:
    """Write usable rows as records and the others to quarantine; every row goes to exactly one."""
    with _kept(df, uses=2):
        append_raw(df.filter(F.col(reason).isNull()), good_path, layout)
        append_quarantine(df.filter(F.col(reason).isNotNull()), quarantine_path)


def append_quarantine(df: DataFrame, path: str) -> None:
    """Append rejected rows (link, stage, reason, raw) as JSON lines; `raw` may hold any text."""
    df.select(*schemas.QUARANTINE).write.mode("append").json(path)


def append_error_links(df: DataFrame, path: str) -> None:
    """Append just the links of rejected rows, one per line."""
    df.select(F.col("link").cast("string")).filter("link IS NOT NULL").write.mode("append").text(path)


@contextmanager
def _kept(df: DataFrame, uses: int):
    """Hold `df` while it is written more than once; lost blocks are recomputed by Spark."""
    if uses < 2:
        yield
        return
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        df.unpersist()
