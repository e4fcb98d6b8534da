"""Sketches of the terms in each file of a page table, so that a keyword search leaves out files that can't match.

A search looks for terms as parts of the text, so what is sketched are all pieces of four characters: a
file whose sketch lacks a piece of a term holds the term nowhere. Sketches are bitmaps, some 128 KB a file; a file that
is not in the index, or was written anew since, is always read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.once import computed_once
from .pages import posting_texts

PIECE = 4
#: Bits of a file's sketch, of one of its rows and of a number that they are gathered in.
BITS = 1 << 20
BUCKET = 1 << 15
GATHERED = 64
_SCHEMA = "file string, changed string, bucket long, bits binary"


def _file() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").cast("string").alias("changed")]


def _bit(piece: Column) -> Column:
    # bitmap positions count from 1
    return F.pmod(F.xxhash64(piece), F.lit(BITS)) + 1


def sketches(pages: DataFrame) -> DataFrame:
    """(file, changed, bucket, bits) of the files of `pages`, as read from files.

    Bits are gathered in numbers, which every task keeps for itself in a hash table of at most BITS / GATHERED rows
    a file, however long the texts; bitmaps are put together from those, a few hundred at a time.
    """
    texts = posting_texts(pages.select("page_id", "url", "html", *_file()))
    searched = F.lower(F.concat_ws(" ", "title", "jd"))
    characters = computed_once(texts.select("file", "changed", "title", "jd"), {"_c": F.split(searched, "")})
    starts = F.sequence(F.lit(0), F.size("_c") - PIECE)
    # places count from 0
    places = F.transform(starts, lambda i: _bit(F.concat(*[F.get("_c", i + k) for k in range(PIECE)])) - 1)
    long_enough = characters.filter(F.size("_c") >= PIECE)
    listed = long_enough.select("file", "changed", F.explode(F.array_distinct(places)).alias("place"))
    # the first byte of a bitmap is the highest of a number
    shift = GATHERED - 8 - F.expr(f"place % {GATHERED} div 8 * 8") + F.col("place") % 8
    numbers = listed.groupBy("file", "changed", F.expr(f"place div {GATHERED}").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), shift.cast("int"))).alias("number")
    )
    many = BUCKET // GATHERED
    buckets = numbers.groupBy("file", "changed", F.expr(f"word div {many} + 1").alias("bucket")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("word") % many, "number"))).alias("held")
    )
    hexes = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")),
        lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))), GATHERED // 4, "0"),
    )
    return buckets.select("file", "changed", "bucket", F.unhex(F.array_join(hexes, "")).alias("bits"))


def index_terms(pages: DataFrame, path: str) -> None:
    """Add the sketches of the files of `pages` (as read from files, nothing done to it yet) to an index.

    Texts are read once; no more than the numbers of a file's sketch are shuffled by each task.
    """
    # a file without any piece has a sketch too
    empty = pages.select(*_file()).distinct().select(
        "file", "changed", F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits")
    )
    sketches(pages).unionByName(empty).write.mode("append").parquet(path)


def files_without(spark: SparkSession, index: str, query: str) -> DataFrame:
    """(file, changed) of the indexed files that hold no text with every term of the query."""
    stored = spark.read.schema(_SCHEMA).parquet(index)
    pieces = {term[i:i + PIECE] for term in query.lower().split() for i in range(len(term) - PIECE + 1)}
    files = stored.select("file", "changed").distinct()
    if not pieces:
        return files.filter(F.lit(False))
    wanted = spark.createDataFrame([(piece,) for piece in sorted(pieces)], "piece string").select(_bit(F.col("piece")).alias("bit"))
    wanted = wanted.select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("position")).distinct()
    # the pieces of one query: a handful of rows
    byte = F.col("bits").substr((F.col("position") / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("position") % 8).cast("int"))
    held = stored.filter("bits IS NOT NULL").join(F.broadcast(wanted), "bucket").filter(bit == 1)
    complete = held.groupBy("file", "changed").agg(F.count("*").alias("n")).filter(F.col("n") >= F.lit(wanted.count()))
    return files.join(complete, ["file", "changed"], "left_anti")


def only_files_with(pages: DataFrame, query: str, index: str) -> DataFrame:
    """`pages`, as read from files, without the files that an index says hold no match. The filter names files by path and
    time of change, so Spark drops them before it opens any.

    The list of files goes to the driver, which lists all files of a table anyway.
    """
    names = [f"{row['file']} {row['changed']}" for row in files_without(pages.sparkSession, index, query).collect()]
    if not names:
        return pages
    file, changed = _file()
    return pages.filter(~F.concat_ws(" ", file, changed).isin(names))
