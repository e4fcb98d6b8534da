"""The older way to a digest: put raw files together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.records import digest
from ..sinks.files import write_digest
from ..sources.raw_csv import misfits, read_raw_postings

READ = "read"


def merge(
    spark: SparkSession,
    paths: list[str],
    targets: list[str] = (),
    layout: str = "raw_v1",
) -> tuple[DataFrame, DataFrame]:
    """(digest, quarantine) of some raw files, written to every target. No filter, repeats kept.

    Lines that do not fit the layout go to quarantine. The inputs are left in place.
    """
    rows = read_raw_postings(spark, list(paths), layout)
    merged = digest(rows.filter(~misfits()))
    bad = rows.filter(misfits()).select(
        "link", F.lit(READ).alias("stage"), F.lit("bad_row").alias("reason"), F.col(schemas.CORRUPT).alias("raw")
    )
    if targets:
        write_digest(merged, list(targets))
    return merged, bad
