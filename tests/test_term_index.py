"""Keyword searches that leave files out."""

import glob

import pytest
from pyspark.sql import functions as F

from postsieve import scratch_path
from postsieve.operators.filters import keyword_filter
from postsieve.plans.daily import daily
from postsieve.plans.search import search
from postsieve.sources.pages import posting_texts
from postsieve.sources.term_index import files_without, index_terms, only_files_with, sketches
from tests.test_commands import NOW, frames, make

WORDS = ["kafka streams", "Kubernetes", "été à Paris", "x", "", "django and flask"]


@pytest.fixture
def table(spark):
    """Six files, each about one thing."""
    path = scratch_path(spark, "pages")
    for i, word in enumerate(WORDS):
        rows = [(i * 10 + k, f"http://h/{i}", f"<h1>T{k}</h1><article>{word} {'filler ' * k if word else ''}</article>") for k in range(5)]
        spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.mode("append").parquet(path)
    return path


def found(pages, query):
    return sorted(r["page_id"] for r in keyword_filter(posting_texts(pages), query).select("page_id").collect())


def test_same_pages_from_fewer_files(spark, table):
    index = scratch_path(spark, "terms")
    pages = spark.read.parquet(table)
    index_terms(pages, index)
    for query, without in [("kafka", 5), ("KUBERNETES", 5), ("paris", 5), ("été", 0), ("flask filler", 5), ("nothing", 6), ("x", 0), ("", 0),
                           ("afka stream", 5), ("kubernetes kafka", 6)]:
        assert files_without(spark, index, query).count() == without, query
        few = only_files_with(pages, query, index)
        assert found(few, query) == found(pages, query)


def test_files_without_a_term_are_not_opened(spark, table):
    index = scratch_path(spark, "terms")
    index_terms(spark.read.parquet(table), index)
    pages = spark.read.schema("page_id bigint, url string, html string").parquet(table)
    skipped = {r["file"].removeprefix("file://") for r in files_without(spark, index, "kafka").collect()}
    want = found(pages, "kafka")
    few = only_files_with(pages, "kafka", index)
    read = few.select("html").filter(F.length("html") >= 0)
    assert len(read.collect()) == 5
    leaf = read._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert found(few, "kafka") == want and len(skipped) == 5
    assert leaf.metrics().apply("numFiles").value() == 1


def test_files_that_are_new_or_changed_are_read(spark, table):
    index = scratch_path(spark, "terms")
    index_terms(spark.read.parquet(table), index)
    more = [(99, "http://h/9", "<h1>T</h1><article>kafka too</article>")]
    spark.createDataFrame(more, "page_id bigint, url string, html string").coalesce(1).write.mode("append").parquet(table)
    pages = spark.read.parquet(table)
    assert found(only_files_with(pages, "kafka", index), "kafka") == [0, 1, 2, 3, 4, 99]
    # a second delivery is indexed alone and added
    index_terms(pages.filter(F.col("_metadata.file_path").contains("part")), index)
    assert found(only_files_with(pages, "kafka", index), "kafka") == [0, 1, 2, 3, 4, 99]
    assert len(glob.glob(f"{table.removeprefix('file:')}/*.parquet")) == 7


def test_commands_with_an_index(spark):
    data = make(seed=12)
    pages, sightings, scores = frames(spark, *data)
    path, index = scratch_path(spark, "pages"), scratch_path(spark, "terms")
    pages.repartitionByRange(6, F.col("html").contains("Python"), "page_id").write.parquet(path)
    pages = spark.read.parquet(path)
    index_terms(pages, index)
    for command, given in ((search, {"page_count": 2, "timeline": "1M"}), (daily, {"yoe": 2})):
        plain = command(pages, sightings, NOW, query="python", scores=scores, **given)
        indexed = command(pages, sightings, NOW, query="python", scores=scores, term_index=index, **given)
        assert sorted(map(str, indexed.records().collect())) == sorted(map(str, plain.records().collect()))
        assert plain.records().count() > 0


def test_sketches_are_gathered_without_a_sort(spark, table):
    plan = sketches(spark.read.parquet(table))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    rows = sketches(spark.read.parquet(table)).collect()
    # bitmaps of whole buckets, each bit where the functions for bitmaps count it
    assert rows and all(len(r["bits"]) == 4096 for r in rows)
    place = spark.sql("SELECT pmod(xxhash64('kafk'), 1048576) + 1 AS b").selectExpr(
        "bitmap_bucket_number(b) AS bucket", "bitmap_bit_position(b) AS position").first()
    held = [r for r in rows if r["bucket"] == place["bucket"] and r["bits"][place["position"] // 8] >> place["position"] % 8 & 1]
    assert len(held) == 1
