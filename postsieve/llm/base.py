"""Helpers that several operators share: words, row keys, written intermediates, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.session import settled_table

# fixed values: what separates words (space and the controls from tab to carriage return)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(ident: Column, text: Column) -> Column:
    """What tells rows apart even where ids are null or repeat; rows equal in both share it."""
    return F.struct(ident.alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared checkpoint folder and read again: computed once, survives lost executors."""
    return settled_table(df, name)


def running_total(df: DataFrame, order: list[Column], value: str, out: str, by: list[str] = ()) -> DataFrame:
    """Add `out`: the sum of `value` over the rows up to this one, in `order`, within each `by` group.

    Rows are dealt out by range and written with their place, then each range is summed alone and
    gets the total of the ranges before it. No task holds a group, however large; `order` should
    tell rows apart, else the order among equals is free. Columns named `_part` and `_before` are
    used up on the way.
    """
    keys = [F.col(c).asc_nulls_last() for c in by]
    placed = settle(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    # one row per range and group in it: at most the ranges plus the groups
    sums = placed.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    ranges = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_part").alias("_at"),
        F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(before, same)
        .withColumn(out, F.col("_before") + F.sum(value).over(within))
        .drop("_part", "_at", "_before", *[f"_by_{c}" for c in by])
    )
