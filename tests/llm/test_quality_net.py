import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from postsieve.llm import quality_net
from tests.llm.helpers import documents, empty, frame

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_odd_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    net = quality_net.train(docs, labels, max_rows=500)
    rows = duckdb.sql(f"SELECT doc_id, text, quality FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id)").fetchall()
    held = [(t.encode(), q) for i, t, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    scores = np.concatenate([net.scores([t for t, _ in held[i:i + 50]]) for i in range(0, len(held), 50)])
    truth = np.array([q for _, q in held])
    assert (scores[truth == 1] >= 0.3).mean() >= 0.97
    assert (scores[truth == 0] < 0.3).mean() >= 0.75

    odd = documents()[:40] + [(-1, None), (-2, ""), (-3, "x"), (-4, "a" * 300_000), (None, "same"), (5, "same"), (5, "same")]
    got = quality_net.score(frame(spark, odd), net, keep=["doc_id"]).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[-1] == by_id[-2]
    text = dict(odd)
    for ident in (0, 1, -3, -4):
        assert abs(by_id[ident] - net.scores([text[ident].encode()])[0]) < 1e-4
    kept = quality_net.keep_good(frame(spark, odd), net)
    assert kept.columns == frame(spark, odd).columns
    assert kept.count() == sum(r["score"] >= quality_net.THRESHOLD for r in got)
    assert quality_net.score(empty(spark), net, keep=["doc_id"]).count() == 0


def test_gradients_match_differences():
    net = quality_net.Net(3)
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (700, 5, 260, 0)]
    labels = np.array([0, 1, 1, 0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        s = net.scores(texts)
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    grads = net.gradients(texts, labels)
    for name, grad in grads.items():
        flat = net.p[name].reshape(-1)
        for i in np.argsort(-np.abs(grad.reshape(-1)))[:3]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - grad.reshape(-1)[i]) < 1e-3


def test_without_labels_the_net_still_scores(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = quality_net.train(frame(spark, documents()[:5]), none)
    assert quality_net.score(frame(spark, documents()[:5]), net, keep=["doc_id"]).count() == 5


def test_repeated_ids_add_one_text_each_to_the_fit(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality_net.Net, "fit", lambda self, texts, labels, epochs: fitted.append((texts, list(labels))))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:20]
    docs = spark.createDataFrame([(i, f"text {i} {n}") for i in ids for n in range(1 if i else 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] * 2, "doc_id long, quality int")
    for shuffled in (docs, docs.orderBy(F.desc("text"))):
        quality_net.train(shuffled, labels, max_rows=8)
    (texts, marks), again = fitted
    assert (texts, marks) == again and 0 < len(texts) <= 16 and len(set(t.split()[1] for t in texts)) == len(texts)


def test_a_batch_in_parts_has_the_same_gradients(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (0, 900, 40, 2_000, 1, 700, 300)]
    labels, rows = np.array([0, 1, 1, 0, 1, 0, 1], np.float32), np.arange(7)
    net = quality_net.Net(2)
    whole = net._batch(texts, labels, rows)
    monkeypatch.setattr(quality_net, "BLOCK", 1_000)
    for k, g in net._batch(texts, labels, rows).items():
        assert np.allclose(g, whole[k], atol=1e-6), k


def test_texts_alone_go_to_python(spark):
    docs, net = frame(spark, documents()[:20]), quality_net.Net()
    kept = quality_net.keep_good(docs, net)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    good = {r["doc_id"] for r in quality_net.score(docs, net, keep=["doc_id"]).collect() if r["score"] >= quality_net.THRESHOLD}
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] in good)
