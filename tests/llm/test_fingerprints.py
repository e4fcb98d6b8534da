import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postsieve.llm import fingerprints as P
from postsieve.llm import queries
from tests.llm.helpers import documents, empty, frame


def trials(rows, hashes):
    """Answers of edit_trial, by the definition."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]]))
    want = Counter()
    for k, (ident, text) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, changed, other = (P.fingerprint(x.encode()) for x in (text, edited, following))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want[(ident, len(text), digest, own.hex(), changed.hex(), P.likeness(own, changed), P.likeness(own, other))] += 1
    return want


def hashes(df):
    texts = df.select(F.coalesce("text", F.lit("")).alias("text"))
    return {x["text"]: x["h"] for x in texts.withColumn("h", F.xxhash64("text")).collect()}


def test_trial_of_odd_rows(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abc éß\U0001f600\n") for _ in range(r.randint(0, 300)))) for i in range(200)]
    rows += [(7, None), (None, "x y"), (None, ""), (8, "same"), (9, "long word " * 20_000)] + [(400, "same")] * 100
    df = frame(spark, rows, 5)
    assert Counter(map(tuple, P.edit_trial(df).collect())) == trials(rows, hashes(df))
    assert P.edit_trial(empty(spark)).collect() == []
    one = P.edit_trial(frame(spark, [(1, "just one text")])).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["n_chars"] == 13


def test_texts_to_fingerprints(spark):
    rows = [(1, "the same five words again"), (2, "THE same five words again"), (3, None), (4, ""), (5, " \n"), (6, "x"), (6, "x")]
    got = P.add_fingerprints(frame(spark, rows), keep=["doc_id", "spans"]).collect()
    by = {x["doc_id"]: x["fingerprint"] for x in got}
    assert len(got) == 7 and by[1] == by[2] and by[3] == by[4] == by[5] == "0" * 32 and by[6] != by[1]


def test_likeness_follows_similarity():
    r = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    text = [r.choice(words) for _ in range(2000)]
    own, before = P.fingerprint(" ".join(text).encode()), 1.0
    for share in (0.02, 0.1, 0.3, 1.0):
        other = text[:]
        for i in range(int(share * 2000)):
            other[i] = r.choice(words)
        now = P.likeness(own, P.fingerprint(" ".join(other).encode()))
        assert now < before
        before = now
    assert abs(before - 0.5) < 0.2


@pytest.mark.parametrize("part,tables,matching", [(2048, 84, None), (7, 84, None), (7, 1, None), (50, 84, 2), (2048, 84, 3)])
def test_near_against_all_pairs(spark, monkeypatch, part, tables, matching):
    monkeypatch.setattr(P, "PART", part)
    monkeypatch.setattr(P, "MAX_TABLES", tables)
    if matching:
        monkeypatch.setattr(P, "_matching", lambda radius, rows: matching)
    r, prints = random.Random(9), []
    for _ in range(40):
        base = r.getrandbits(128)
        for _ in range(r.randint(1, 30)):
            x = base
            for _ in range(r.randint(0, 8)):
                x ^= 1 << r.randrange(128)
            prints += [x.to_bytes(16, "big").hex()] * r.randint(1, 3)
    # one cluster that shares most of its blocks
    prints += [(i << 3).to_bytes(16, "big").hex() for i in range(200)]
    counts = Counter(prints)
    df = spark.createDataFrame([(p, 1) for p in prints] + [(None, 1)], "fingerprint string, n int")
    for radius in (0, 3, 6):
        want = {
            (a, n, sum(m for b, m in counts.items() if b != a and (int(a, 16) ^ int(b, 16)).bit_count() <= radius))
            for a, n in counts.items()
        }
        assert {tuple(x) for x in P.near(df, radius).collect()} == want
    assert P.near(df.where("n = 2")).collect() == []


def test_more_fingerprints_make_longer_keys():
    assert [P._matching(6, n) for n in (0, 1000, 10**6, 10**9)] == sorted(P._matching(6, n) for n in (0, 1000, 10**6, 10**9))
    assert P._matching(6, 10**9) > 1
    for m in (1, 2, 3):
        places = P.blocks(6, m)
        assert len(places) == 6 + m and sum(n for _, n in places) == 32 and all(n for _, n in places)


def test_query(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = queries.queries()["op11_fingerprints"](spark, "/root/testdata/sf0.001").collect()
    assert Counter(tuple(x)[:7] for x in got) == trials(rows, hashes(df))
    assert sum(x["near_edited"] > x["near_next"] for x in got) / len(got) > 0.95
