import hashlib
import re
from collections import Counter

import pytest

from postsieve.llm import queries, suffix_dedup
from tests.llm.helpers import SF, documents, empty, frame, rows_of


def brute(rows, length):
    seen = Counter()
    bodies = [(ident, (text or "").encode()) for ident, text in rows]
    for _, body in bodies:
        seen.update(body[s:s + length] for s in range(len(body) - length + 1))
    out = Counter()
    for ident, body in bodies:
        gone = bytearray(len(body))
        for s in range(len(body) - length + 1):
            if seen[body[s:s + length]] > 1:
                gone[s:s + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        left = bytes(b for b, g in zip(body, gone) if not g)
        out[ident, len(body), sum(gone), spans, hashlib.sha256(left).hexdigest()] += 1
    return out


def odd():
    some = documents()[:60]
    return some + [
        (-1, None), (-2, ""), (-3, "a" * 1000), (-4, "é" * 300), (None, "xyz" * 200), (7, some[0][1]), (7, some[0][1]),
        (-5, some[3][1][:50] * 20), (-6, "q" + some[5][1][:420] + "r" + some[6][1][10:430]),
    ]


@pytest.mark.parametrize("length, key", [(400, 200), (60, 20)])
def test_against_brute_force(spark, length, key):
    rows = odd()
    got = rows_of(suffix_dedup.remove_repeats(frame(spark, rows), length=length, key=key))
    assert got == brute(rows, length)


def test_joins_without_broadcast_share_one_shuffle_of_texts(spark, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = odd()
        df = suffix_dedup.remove_repeats(frame(spark, rows))
        assert rows_of(df) == brute(rows, 400)
        df.explain()
        assert "ReusedExchange" in capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_kept_bytes(spark):
    rows = odd()
    for row in suffix_dedup.remove_repeats(frame(spark, rows), keep_text=True).collect():
        assert row["kept"] is None or hashlib.sha256(row["kept"]).hexdigest() == row["kept_sha256"]
        assert row["kept"] is None or len(row["kept"]) == row["n_bytes"] - row["n_removed"]


def test_empty(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def brute_words(rows, length):
    seen = Counter()
    bodies = [(ident, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for ident, text in rows]
    for _, body in bodies:
        seen.update(tuple(body[s:s + length]) for s in range(len(body) - length + 1))
    out = Counter()
    for ident, body in bodies:
        gone = [False] * len(body)
        for s in range(len(body) - length + 1):
            if seen[tuple(body[s:s + length])] > 1:
                gone[s:s + length] = [True] * length
        out[ident, sum(gone)] += 1
    return out


def passages():
    """Passages of 51 and 50 words, all below 400 bytes, with other blanks in the second text; a long word in some."""
    some = [f"w{i}" for i in range(51)]
    long = ["ab" * 200] + [f"v{i}" for i in range(60)]
    return [
        (1001, "before " + " ".join(some) + " after"), (1002, "x\t" + "\n".join(some) + "  y z"),
        (1003, "p " + " ".join(some[:50]) + " q"), (1004, "W0 " + " ".join(some[1:]) + " r"),
        (1005, " ".join(long)), (1006, "o " + " \r".join(long)), (1007, "é " * 60),
    ]


@pytest.mark.parametrize("words, word_key", [(51, 20), (8, 3)])
def test_words_against_brute_force(spark, words, word_key):
    rows = odd() + passages()
    df = suffix_dedup.remove_repeats(frame(spark, rows), words=words, word_key=word_key)
    assert rows_of(df.drop("n_repeated_words")) == brute(rows, 400)
    assert rows_of(df.select("doc_id", "n_repeated_words")) == brute_words(rows, words)


def test_passage_of_over_50_words_below_400_bytes(spark, tmp_path):
    frame(spark, passages()).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.queries()["op1_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got[1001]["n_repeated_words"] == got[1002]["n_repeated_words"] == 51
    assert got[1003]["n_repeated_words"] == got[1004]["n_repeated_words"] == 0
    assert got[1001]["n_removed"] == 0


def test_words_of_the_query(spark):
    df = queries.queries()["op1_suffix_dedup"](spark, SF).select("doc_id", "n_repeated_words")
    assert rows_of(df) == brute_words(documents(), suffix_dedup.WORDS)
