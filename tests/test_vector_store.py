"""Vectors kept between runs."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postsieve import scratch_path
from postsieve.operators import vector_store as V
from postsieve.plans.daily import daily
from postsieve.plans.search import recommended, search
from postsieve.sinks.pages import write_pages
from postsieve.sources.fetch import by_ids
from tests.test_commands import NOW, frames, make


def counting(folder):
    """An encoder that leaves a file for every text it encodes."""

    def make_predict():
        import os
        import uuid

        import numpy as np

        def predict(texts):
            for _ in texts:
                open(os.path.join(folder, str(uuid.uuid4())), "w").close()
            return np.array([[len(t), t.count("a"), t.count("e") + 1] for t in texts], dtype="float32")

        return predict

    return make_predict


def vector(text):
    return [len(text), text.count("a"), text.count("e") + 1]


def cosine(a, b):
    return 100 * sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5


@pytest.fixture
def encoder(spark, tmp_path):
    return V.Encoder(counting(str(tmp_path)), scratch_path(spark, "vectors"), "toy", batch_size=8)


def pages_of(spark, bodies):
    rows = [(i, f"http://x/{i}", f"<html><nav>{i}</nav><h1>t</h1><article>{b}</article></html>") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def profile_of(spark, text="a profile"):
    return spark.createDataFrame([(text,)], "profile string")


def test_only_unseen_contents_are_encoded(spark, encoder, tmp_path):
    bodies = [f"text {i % 30} e" for i in range(60)] + ["", "a<b>b</b>"]
    first = V.encoded_scores(pages_of(spark, bodies[:40]), profile_of(spark), encoder).collect()
    assert len(first) == 40
    # of equal contents one is encoded, and the profile once
    assert len(os.listdir(tmp_path)) == 30 + 1
    again = V.encoded_scores(pages_of(spark, bodies[:40]), profile_of(spark), encoder).collect()
    assert len(os.listdir(tmp_path)) == 31 and sorted(again) == sorted(first)
    more = V.encoded_scores(pages_of(spark, bodies), profile_of(spark), encoder).collect()
    assert len(os.listdir(tmp_path)) == 33
    texts = [b.replace("<b>", "").replace("</b>", "") for b in bodies]
    want = {i: cosine(vector(t), vector("a profile")) for i, t in enumerate(texts)}
    assert {r["page_id"]: pytest.approx(r["match_score"], abs=1e-9) for r in more} == want
    # another profile needs one more encoding, another encoder all of them
    V.encoded_scores(pages_of(spark, bodies), profile_of(spark, ""), encoder)
    assert len(os.listdir(tmp_path)) == 34
    other = V.Encoder(encoder.make_predict, encoder.store, "other")
    V.encoded_scores(pages_of(spark, bodies[:3]), profile_of(spark), other)
    assert len(os.listdir(tmp_path)) == 34 + 4


def test_many_new_pages_and_a_store_with_repeats(spark, encoder, tmp_path, monkeypatch):
    bodies = [f"text {i % 20} e" for i in range(50)]
    monkeypatch.setattr(V, "LISTED_IDS", 5)
    first = V.encoded_scores(pages_of(spark, bodies), profile_of(spark), encoder).collect()
    # a second writer has stored the same contents at the same time
    kept = spark.read.parquet(encoder.path)
    kept.write.parquet(scratch_path(spark, "copy"))
    copy = spark.createDataFrame(kept.collect(), kept.schema)
    copy.write.mode("append").parquet(encoder.path)
    again = V.encoded_scores(pages_of(spark, bodies), profile_of(spark), encoder).collect()
    assert sorted(first) == sorted(again) and len(again) == 50
    assert V.encoded_scores(pages_of(spark, bodies).filter(F.lit(False)), profile_of(spark), encoder).count() == 0


def test_a_second_daily_run_encodes_no_known_page(spark, encoder, tmp_path):
    pages, sightings, _ = frames(spark, *make(seed=3))
    profile = profile_of(spark, "python engineer")

    def run():
        got = daily(pages, sightings, NOW, "engineer", "USA", yoe=2, profile=profile, encoder=encoder)
        return [(r["link"], r["match_score"]) for r in got.digest(with_score=True).collect()]

    first = run()
    encoded = len(os.listdir(tmp_path))
    assert first and encoded == pages.select("html").distinct().count() + 1
    assert run() == first and len(os.listdir(tmp_path)) == encoded
    ranked = recommended(pages, profile=profile, encoder=encoder).records().collect()
    assert len(ranked) == 25 and len(os.listdir(tmp_path)) == encoded


def test_a_search_encodes_what_it_lists(spark, encoder, tmp_path):
    pages, sightings, _ = frames(spark, *make(seed=3, n_pages=60, n_sightings=60, hot=0))
    run = search(pages, sightings, NOW, "python", "USA", "7D", page_count=1, profile=profile_of(spark), encoder=encoder)
    rows = run.rows.select("page_id", "match_score").distinct().collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert 0 < len(os.listdir(tmp_path)) - 1 <= len(rows) < 60
    for row in rows:
        body = html[row["page_id"]].split("<article><p>")[1].split("</p>")[0]
        assert row["match_score"] == pytest.approx(cosine(vector(body), vector("a profile")), abs=1e-9)


def test_scores_or_an_encoder(spark, encoder):
    pages, sightings, scores = frames(spark, *make(n_sightings=5))
    for command in (search, daily):
        with pytest.raises(ValueError):
            command(pages, sightings, datetime(2024, 1, 31), scores=scores, encoder=encoder)
    with pytest.raises(ValueError):
        recommended(pages, scores=scores, encoder=encoder)


def test_fetch_opens_few_row_groups(spark, capsys):
    path = scratch_path(spark, "pages")
    table = spark.range(20_000).select(
        ((F.col("id") * 7919) % 20_000).alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("html")
    )
    write_pages(table.repartition(3), path, row_group_bytes=1024 * 1024)
    pages = spark.read.parquet(path)
    ids = spark.createDataFrame([(7,), (9_000,), (9_000,), (None,), (99_999,)], "page_id bigint")
    got = by_ids(pages, ids, "page_id")
    assert sorted(r["page_id"] for r in got.collect()) == [7, 9_000]
    read = got._jdf.queryExecution().executedPlan()
    rows = [m for m in str(read.toString()).split("\n") if "PushedFilters" in m]
    assert rows and "In(page_id, [7,9000,99999])" in rows[0]
    scanned = read.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert scanned < 10_000
    joined = by_ids(pages, ids, "page_id", listed=2)
    assert sorted(r["page_id"] for r in joined.collect()) == [7, 9_000]
    joined.explain()
    assert "GreaterThanOrEqual(page_id,7)" in capsys.readouterr().out
    assert by_ids(pages, ids.filter("page_id IS NULL"), "page_id").count() == 0
