"""First-seen selection, page limits and page numbers.

Arrival order inside a scan is newest first: `ts DESC, event_id`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims
from ..session import settled_table

_FEW_SCANS = 1_000
#: Rows of a list that are taken by a top-k and numbered in one task; longer lists go by range.
FEW_ROWS = 1_000
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
# ranks of a quantile are off by one in so many
_ACCURACY = 10_000
_ROW_BITS = 33  # monotonically_increasing_id = (partition << 33) + row within partition


def newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("event_id").asc()]


def first_seen(
    df: DataFrame, key: str = "link", order: Sequence[Column | str] = (), copies: int = 1
) -> DataFrame:
    """The first row of every key in arrival order (or the first few, with `copies`).

    Spark turns `row_number() <= n` into a group limit on both sides of the shuffle: each map
    task sends at most `copies` rows per key, so a key that holds a third of all rows costs no
    more than any other. Spark does so up to a number of copies that the session sets; it is raised here
    where more are asked for. Filter before calling: a dropped first copy must not hide a later one.
    """
    session = df.sparkSession.conf
    if copies >= int(session.get(_GROUP_LIMIT, "1000")):
        session.set(_GROUP_LIMIT, str(copies + 1))
    order = list(order) or [F.col("scan_rank"), *newest_first()]
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= copies).drop("_rank")


def page_limit(
    df: DataFrame, order: Sequence[Column | str], page_count: int = 1, page_size: int = dims.PAGE_SIZE
) -> DataFrame:
    """The first pages of a scan: a top-k, each task keeping only its own best rows.

    Pass narrow rows; fetch wide columns for the few survivors afterwards.
    """
    return df.orderBy(*order).limit(page_size * page_count)


def single_page(
    df: DataFrame, order: Sequence[Column | str], page: int, page_size: int = dims.PAGE_SIZE
) -> DataFrame:
    """One page of a scan, counted from 0."""
    return df.orderBy(*order).offset(page_size * page).limit(page_size)


def number_listed(df: DataFrame, order: Sequence[Column | str], page_size: int = dims.PAGE_SIZE) -> DataFrame:
    """Add `page` and `position` to the rows left by `page_limit`.

    One task numbers them all, which is fine for some pages of rows and for nothing larger:
    use `number_pages` on a whole scan.
    """
    listed = df.withColumn("_seq", F.row_number().over(W.orderBy(*order)) - 1)
    return _as_pages(listed, page_size)


def listed_pages(
    df: DataFrame,
    order: Sequence[Column | str],
    key: Column,
    page_count: int,
    page_size: int = dims.PAGE_SIZE,
) -> DataFrame:
    """The first pages of a scan, with `page` and `position`, whatever their number.

    `key` is what `order` starts with, in descending order, nulls last. Short lists are a top-k that one task numbers. For
    longer ones that task would get a full list from every other, so rows are first thinned to
    those at or above a quantile of the key, then numbered by range.
    """
    rows = page_count * page_size
    if rows <= FEW_ROWS:
        return number_listed(page_limit(df, order, page_count, page_size), order, page_size)
    kept = settled_table(df, "list_rows")
    return number_pages(_above_quantile(kept, key, rows), order, page_size=page_size).filter(F.col("page") < page_count)


def _above_quantile(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """The rows of at least the first `rows` keys in descending order, and not many more unless keys are equal.

    A quantile is known to within its accuracy, so it is asked for with room to spare, and again among
    what is left. Every round is one aggregate over the key, by a filter on it.
    """
    left, keyed = df, df.agg(F.count(key)).first()[0]
    kind = df.select(key).schema[0].dataType
    while keyed > 4 * rows:
        share = min(1.0, (rows + 2 * keyed / _ACCURACY + 1) / keyed)
        # by way of text, so that no Python time zone gets between
        bound = left.select(F.percentile_approx(key, 1 - share, _ACCURACY).cast("string")).first()[0]
        inside = left.filter(key >= F.lit(bound).cast(kind))
        count = inside.count()
        if count < rows or count > 0.9 * keyed:
            break
        left, keyed = inside, count
    return left


def number_pages(
    df: DataFrame,
    order: Sequence[Column | str],
    scan: str | None = None,
    page_size: int = dims.PAGE_SIZE,
) -> DataFrame:
    """Add `page` and `position` to every row of a whole scan (or of each scan in `scan`).

    No task ever holds a scan: the rows are range-partitioned in arrival order and written with
    their partition and their place in it, counted per partition, and numbered by offset plus
    place. The written table settles which row is where, whatever executors are lost later.
    """
    by = [scan] if scan else []
    place = F.monotonically_increasing_id()
    placed = settled_table(
        df.orderBy(*by, *order).select(
            "*",
            F.shiftright(place, _ROW_BITS).alias("_part"),
            place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
        ),
        "placed_rows",
    )
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset")
    )
    # one row per partition plus one per scan, so few as long as the scans are few
    if scan is None or placed.select(scan).distinct().limit(_FEW_SCANS + 1).count() <= _FEW_SCANS:
        offsets = F.broadcast(offsets)
    numbered = placed.join(offsets, [*by, "_part"]).withColumn("_seq", F.col("_offset") + F.col("_row"))
    return _as_pages(numbered.drop("_part", "_row", "_offset"), page_size)


def _as_pages(df: DataFrame, page_size: int) -> DataFrame:
    return df.select(
        "*",
        F.floor(F.col("_seq") / page_size).cast("bigint").alias("page"),
        (F.col("_seq") % page_size).cast("bigint").alias("position"),
    ).drop("_seq")
