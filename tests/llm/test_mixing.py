from collections import defaultdict

import pytest

from postsieve.llm import mixing
from tests.llm.helpers import empty, words


def fill(sizes, weights, repeats=3):
    """Targets by the rule in words: share, stop, share the excess again."""
    budget, stopped = float(sum(sizes.values())), {}
    while True:
        left = {s: w for s, w in weights.items() if s not in stopped}
        if not left:
            return stopped
        rest = budget - sum(stopped.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = {s: float(repeats * sizes[s]) for s in left if share[s] > repeats * sizes[s]}
        if not over:
            return stopped | share
        stopped |= over


def rows():
    out, ident = [], 0
    for source, n, size in (("b", 400, 30), ("a", 30, 12), (None, 60, 25), ("Z", 3, 5), ("é", 200, 18), ("empty", 4, 0)):
        for i in range(n):
            out.append((ident, " ".join(f"w{i + j}" for j in range(size - i % 3 if size else 0)), source))
            ident += 1
    return out + [(None, None, "a"), (5, "x y", "b"), (5, "x y", "b"), (ident, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    return df.selectExpr("*", "'s' AS size", "9 AS target", "1 AS _u", "2 AS _part").repartition(4)


def test_targets_and_shares(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, text, source in rows():
        sizes[source] += len(words(text))
        longest[source] = max(longest[source], len(words(text)))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert sum(taken.values()) <= sum(sizes.values())
    for s in sizes:
        # the copy that crosses the end is taken where that is nearer
        assert abs(taken[s] - want[s]) <= 0.6 * longest[s] + 0.02 * want[s], s


def test_reruns_agree_however_rows_are_dealt(docs):
    first = sorted(map(str, mixing.mix(docs).collect()))
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == first


def test_the_mix_repeats_whole_rows(docs):
    copies = {}
    for r in mixing.mix(docs).collect():
        copies.setdefault(r["doc_id"], []).append(r["copies"])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r["doc_id"]] += 1
    for ident, n in copies.items():
        if len(n) == 1 and ident is not None:
            assert seen[ident] == n[0]


def test_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed(empty(spark)).count() == 0
