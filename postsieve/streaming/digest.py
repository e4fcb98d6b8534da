"""The digest kept up to date as sightings arrive."""

from __future__ import annotations

import zlib

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import dims, schemas
from ..functions.predicates import suitable
from ..functions.text import strip_commas
from ..operators import ordering, records

STREAM = "stream"


def judged(sightings: DataFrame, yoe: int = dims.DEFAULT_YEARS) -> DataFrame:
    """Sightings (event_id, ts, page_id, response) with the fields of their answers: usable rows that
    are suitable, and rows with a `reason`."""
    parsed = records.parse_responses(sightings.select("event_id", "ts", "page_id", "response"))
    typed = records.type_fields(parsed.withColumn("company", strip_commas(F.col("company"))))
    return records.check_experience(typed).filter(F.col("reason").isNotNull() | suitable(yoe))


def suitable_rows(sightings: DataFrame, yoe: int = dims.DEFAULT_YEARS) -> DataFrame:
    return judged(sightings, yoe).filter(F.col("reason").isNull())


def append_digest(
    sightings: DataFrame,
    pages: DataFrame,
    path: str,
    quarantine_path: str,
    checkpoint: str,
    yoe: int = dims.DEFAULT_YEARS,
    with_score: bool = False,
) -> StreamingQuery:
    """Append what a stream of sightings adds to a digest and to its quarantine, everything available now.

    `pages` is a static table of page_id, link and title, best a written one. Each batch is split:
    rows with a problem go to quarantine, as do those of unknown pages; of the suitable ones the newest of each
    link is added unless an earlier batch has listed the link. However late a sighting is, it counts.

    Sightings are thinned per page before they are joined, on the map side, so a page seen all the
    time sends one row per task. What is left of a batch, a row per link, is handed to a second stream
    whose state are the links listed so far: it never expires and is looked up by link, so a batch reads its own rows and never the
    digest. A batch that is repeated after a failure finds its links in that state and adds nothing twice.
    Where a digest is continued without its checkpoint, its links are read once, at the start.
    """
    headings = pages.select("page_id", "link", "title")
    spark = pages.sparkSession
    layout = schemas.LAYOUTS["digest"] + (("match_score",) if with_score else ())
    empty = spark.range(0).select(*[F.lit(None).cast(schemas.column_type(name)).alias(name) for name in layout])
    listed = _Listed(spark, path, checkpoint, empty)
    listed.start()

    def add(batch: DataFrame, number: int) -> None:
        rows = judged(batch, yoe).persist(StorageLevel.MEMORY_AND_DISK)
        newest = ordering.first_seen(rows.filter(F.col("reason").isNull()), "page_id", ordering.newest_first())
        linked = newest.join(headings, "page_id", "left").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            unknown = linked.filter(F.col("link").isNull()).withColumns(
                {"stage": F.lit(STREAM), "reason": F.lit("bad_row")}
            )
            bad = rows.filter(F.col("reason").isNotNull()).join(headings, "page_id", "left")
            rejected = bad.unionByName(unknown).select("link", "stage", "reason", F.col("response").alias("raw"))
            rejected.write.mode("overwrite").json(f"{quarantine_path}/batch_id={number}")
            first = ordering.first_seen(linked.filter(F.col("link").isNotNull()), "link", ordering.newest_first())
            listed.offer(records.digest(first, with_score))
        finally:
            rows.unpersist()
            linked.unpersist()

    return (
        sightings.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class _Listed:
    """The links a digest holds, as the state of a stream over the rows offered to it."""

    def __init__(self, spark: SparkSession, path: str, checkpoint: str, empty: DataFrame):
        self.spark, self.path, self.empty = spark, path, empty
        self.offers, self.state = f"{checkpoint}/offers", f"{checkpoint}/links"
        # parts of a digest are named after the checkpoint that added them, so that another one replaces none
        self.name = f"{zlib.crc32(checkpoint.encode()):08x}"
        self.schema = self.empty.withColumn("known", F.lit(True)).schema

    def start(self) -> None:
        if _exists(self.spark, self.offers):
            # what a failed run has offered is taken before anything new
            self._drain()
        elif _exists(self.spark, self.path):
            held = self.spark.read.schema(self.empty.schema).parquet(self.path)
            self._take(ordering.first_seen(held, "link", ["link"]), known=True)
        else:
            # an empty part, so that the digest can be read from the first batch on
            self.empty.write.mode("overwrite").parquet(f"{self.path}/batch_id=-1")
            self.empty.withColumn("known", F.lit(False)).write.mode("append").parquet(self.offers)

    def offer(self, rows: DataFrame) -> None:
        """Add those of some rows, one per link, whose link is new."""
        self._take(rows, known=False)

    def _take(self, rows: DataFrame, known: bool) -> None:
        rows.withColumn("known", F.lit(known)).write.mode("append").parquet(self.offers)
        self._drain()

    def _drain(self) -> None:
        arrived = self.spark.readStream.schema(self.schema).parquet(self.offers)
        query = (
            arrived.dropDuplicates(["link"]).writeStream.foreachBatch(self._add)
            .option("checkpointLocation", self.state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def _add(self, fresh: DataFrame, number: int) -> None:
        fresh.filter(~F.col("known")).drop("known").write.mode("overwrite").parquet(
            f"{self.path}/batch_id={self.name}-{number}"
        )


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("link string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True
