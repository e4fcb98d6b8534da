import json
from collections import Counter
from datetime import datetime, timedelta

import pytest

from postsieve import schemas, scratch_path
from postsieve.operators import ordering
from postsieve.streaming import digest as stream

NOW = datetime(2024, 3, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, page_id bigint, response string"


def answer(i):
    return json.dumps({
        "company": "A, Inc", "min_exp": i % 4, "max_exp": "N/A", "overall": "Java", "primary": "Java", "secondary": "SDE",
        "citizenship_required": False, "security_clearance_required": False, "visa_sponsorship": i % 3 != 0,
    })


@pytest.fixture(scope="module")
def rows():
    # page 0 has half of all sightings; pages come in pairs that share a link; page 19 is seen once,
    # 40 days late; page 77 is unknown; some answers are broken
    out = [(i, NOW + timedelta(minutes=i), 0 if i % 2 else i % 18, answer(i)) for i in range(600)]
    return out + [
        (1000, NOW - timedelta(days=40), 19, answer(1)), (1001, NOW, 77, answer(1)), (1002, NOW, 3, "no json"), (1003, NOW, 4, None),
    ]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(p, f"http://h/{p // 2}", f"t{p}") for p in range(20)], "page_id bigint, link string, title string")


def run(spark, pages, parts):
    """Digest and quarantine after the parts have arrived, one run of the stream for each."""
    source, out, bad, state = (scratch_path(spark, name) for name in ("sightings", "digest", "quarantine", "state"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        stream.append_digest(read, pages, out, bad, state).awaitTermination()
    digest = spark.read.parquet(out).select(*schemas.LAYOUTS["digest"])
    return digest, spark.read.json(bad).select("link", "stage", "reason", "raw")


def test_the_same_links_however_rows_arrive(spark, pages, rows):
    kept = stream.suitable_rows(spark.createDataFrame(rows, SCHEMA)).join(pages, "page_id")
    want = sorted(r["link"] for r in ordering.first_seen(kept, "link", ordering.newest_first()).collect())
    assert "http://h/9" in want
    late_last = rows[:200], rows[200:600], rows[600:]
    for parts in ([rows], late_last, late_last[::-1]):
        digest, rejected = run(spark, pages, parts)
        assert sorted(r["link"] for r in digest.collect()) == want
        assert {r["company"] for r in digest.collect()} == {"A Inc"}
        got = Counter((r["link"], r["stage"], r["reason"]) for r in rejected.collect())
        assert got == Counter([(None, "stream", "bad_row"), ("http://h/1", "parse", "bad_json"), ("http://h/2", "parse", "bad_json")])


def test_a_repeated_batch_adds_nothing_twice(spark, pages, rows):
    source, out, bad = (scratch_path(spark, name) for name in ("sightings", "digest", "quarantine"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    for _ in range(2):
        # without its checkpoint the stream starts again with the same batch number
        read = spark.readStream.schema(SCHEMA).parquet(source)
        stream.append_digest(read, pages, out, bad, scratch_path(spark, "state")).awaitTermination()
    links = [r["link"] for r in spark.read.parquet(out).collect()]
    assert len(links) == len(set(links))
    assert spark.read.json(bad).count() == 3


def test_batches_do_not_read_the_digest(spark, pages, rows):
    """Each batch's rows are looked up in the state; a digest that can't even be read is not missed."""
    source, out, bad, state = (scratch_path(spark, name) for name in ("sightings", "digest", "quarantine", "state"))
    for number, part in enumerate((rows[:300], rows[300:600], rows[600:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(SCHEMA).parquet(source)
        stream.append_digest(read, pages, out, bad, state).awaitTermination()
        if number == 0:
            # earlier parts of the digest are replaced by something unreadable
            spark.createDataFrame([("x",)], "value string").write.text(f"{out}/batch_id=spoiled")
    text = [r["value"] for r in spark.read.text(f"{out}/batch_id=spoiled").collect()]
    assert text == ["x"]
    kept = stream.suitable_rows(spark.createDataFrame(rows, SCHEMA)).join(pages, "page_id")
    want = sorted({r["link"] for r in kept.collect()})
    parts = [r["link"] for r in spark.read.option("pathGlobFilter", "*.parquet").parquet(out).collect()]
    assert sorted(parts) == want


def test_a_digest_goes_on_without_its_checkpoint(spark, pages, rows):
    """Links listed under an earlier checkpoint are not listed again, and none of its rows is lost."""
    source, out, bad = (scratch_path(spark, name) for name in ("sightings", "digest", "quarantine"))
    spark.createDataFrame(rows[:100], SCHEMA).write.parquet(source)
    read = spark.readStream.schema(SCHEMA).parquet(source)
    stream.append_digest(read, pages, out, bad, scratch_path(spark, "state")).awaitTermination()
    before = {tuple(r) for r in spark.read.parquet(out).collect()}
    spark.createDataFrame(rows[100:], SCHEMA).write.mode("append").parquet(source)
    stream.append_digest(read, pages, out, bad, scratch_path(spark, "state")).awaitTermination()
    after = spark.read.parquet(out).collect()
    assert before < {tuple(r) for r in after} and len(after) == len({r["link"] for r in after})
