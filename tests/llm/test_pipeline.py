import corpus_pipeline
from pyspark.sql import functions as F

from postsieve.llm import mixing, pieces
from tests.llm.helpers import documents, frame

SF = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        after = corpus_pipeline.settle(stage(spark, docs, SF), name)
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert set(ids) <= set(before)
        if name != "tokens":
            assert after.columns == columns
        if name in ("quality", "near_duplicates", "secrets"):
            assert len(set(ids)) == len(ids)
        if name == "secrets":
            assert len(ids) == len(before)
        if name == "mixture":
            copies = mixing.mix(docs).agg(F.sum("copies")).first()[0]
            assert len(ids) == copies and max(map(ids.count, set(ids))) <= 3
        if name == "tokens":
            text = {r["doc_id"]: r["text"] for r in pieces.decode(after, keep=["doc_id"]).collect()}
            assert all(text[i] == before[i] for i in before)
        docs = after


def test_stages_on_odd_rows(spark):
    rows = documents()[:30] + [(-1, None), (-2, ""), (None, "no id"), (5, documents()[5][1]), (-3, "x " * 20_000)]
    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, SF), f"odd_{name}")
    assert docs.count() > 0
