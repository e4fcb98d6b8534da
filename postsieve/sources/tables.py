"""Reading the input tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A parquet table. With `spread`, a table of fewer splits than there are cores is dealt out
    to all of them, for work that is heavy per row.

    A table large enough to fill the cluster has more splits than that and is never shuffled,
    so what `spread` moves is at most one split per core.
    """
    table = spark.read.parquet(path)
    if not spread:
        return table
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def newest(df: DataFrame, ts: str = "ts") -> datetime | None:
    """The newest timestamp of a table: the date a run over it looks back from.

    One aggregate over one column, asked for once per run, so that all windows of the run are
    constants.
    """
    return df.agg(F.max(F.col(ts).cast("timestamp_ntz"))).first()[0]
