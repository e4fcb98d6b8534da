import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from postsieve.llm import periodic_runs as P
from postsieve.llm import queries
from tests.llm.helpers import documents, empty, frame


def brute(a, shortest=6, times=4):
    n, out = len(a), []
    for q in range(1, n // times + 1):
        k = 0
        while k < n - q:
            j = k
            while j < n - q and a[j] == a[j + q]:
                j += 1
            length = j - k + q
            if j > k and length >= max(shortest, times * q):
                w = a[k:k + length]
                if all(any(w[x] != w[x + r] for x in range(length - r)) for r in range(1, q)):
                    out.append((k, length, q))
            k = max(j, k + 1)
    return sorted(out, key=lambda t: (t[0], t[2]))


def lyndon(a):
    def is_lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))

    return [max(j - i for j in range(i + 1, len(a) + 1) if is_lyndon(a[i:j])) for i in range(len(a))]


def test_grouping_gives_the_longest_lyndon_words():
    r = random.Random(3)
    for _ in range(400):
        a = [r.randrange(r.randint(1, 3)) for _ in range(r.randint(1, 14))]
        known = sorted(set(a))
        a = [known.index(x) for x in a]
        assert P.lyndon_lengths(a, len(known) - 1) == lyndon(a)


def test_runs_against_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        n, k = r.randint(0, 60), r.choice([1, 2, 2, 3, 5])
        a = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.6 and n > 8:
            s, p = r.randrange(n - 4), r.randint(1, 6)
            for i in range(s + p, min(n, s + p * r.randint(3, 8))):
                a[i] = a[i - p]
        for shortest, times in ((6, 4), (2, 2), (4, 3)):
            assert [tuple(x) for x in P.runs(np.array(a, np.int64), shortest, times).tolist()] == brute(a, shortest, times)


def test_long_texts_in_linear_time():
    n = 200_000
    assert P.runs(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    assert P.runs(np.arange(n) % 20_011).tolist() == [[0, n, 20_011]]
    assert P.runs(np.arange(n)).tolist() == []


def words_of(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def answer(words):
    numbers = {}
    found = brute([numbers.setdefault(w, len(numbers)) for w in words])
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda t: (-Fraction(t[1], t[2]), t[0], t[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if found else None
    return (len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def odd():
    r = random.Random(1)
    texts = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 3, "x a b a b a b a b y", "a " * 7 + "b " * 9 + "a b a b a b a b",
             "é ü é ü " * 6, "A a A a A a A a", "a\tb\x0bc\x0cd\re\nf " * 4, "\x1c \x1d " * 5]
    texts += [" ".join(r.choice("ab") for _ in range(300)), " ".join(r.choice("abc") for _ in range(300)), "w " * 2000]
    return [(-1 - i, t) for i, t in enumerate(texts)] + [(None, "a " * 8), (3, "a " * 8), (3, "a " * 8)]


def test_odd_rows(spark):
    got = Counter()
    for row in P.find(frame(spark, odd()), keep=["doc_id", "score"]).collect():
        got[(row["doc_id"], row["score"], row["n_words"], tuple(map(tuple, row["runs"])), row["collapsed"])] += 1
    want = Counter()
    for doc_id, text in odd():
        words, numbers = (text or "").encode().split(), {}
        found = brute([numbers.setdefault(w, len(numbers)) for w in words])
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()
        want[(doc_id, "y", len(words), tuple(found), kept)] += 1
    assert got == want
    assert P.find(empty(spark), keep=["doc_id"]).collect() == []


def test_query_against_brute_force(spark):
    rows = documents()
    got = queries.queries()["op13_periodic_runs"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = {i: answer(words_of(i, t)) for i, t in rows}
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == want
    assert sum(w[0] > 0 for w in want.values()) >= 5


def test_planted_periods_for_odd_ids(spark):
    rows = odd() + [(i, f"w{i} a b c d e f g h i j k l m n o p") for i in range(60)]
    df = queries._periodic(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((x["doc_id"], tuple((x["text"] or "").encode().split())) for x in df.collect())
    assert got == Counter((i, tuple(words_of(i, t))) for i, t in rows)
