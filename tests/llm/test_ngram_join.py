import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from postsieve.llm import graph, hashing, ngram_join
from tests.llm.helpers import documents, empty, frame, rows_of, words


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    under = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in under[g])
        for g in s:
            under[g].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[rows[i][0], len(sets[i]), min(ids) if ids else None] += 1
    return out


def odd():
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = list(documents())
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        rows.append((100_000 + i, " ".join(w)))
    passage = " ".join(f"p{r.randrange(500)}" for _ in range(60))
    for i in range(120):
        rows.append((200_000 + i, passage + " " + " ".join(f"q{r.randrange(9999)}" for _ in range(r.randrange(10, 120)))))
    return rows + [
        (-1, None), (-2, ""), (-3, " \n\t"), (-4, "a b c"), (-5, "A  B c"), (-6, "a b"), (-7, "x " * 30_000), (-8, "x " * 50),
        (None, "a b c"), (None, None), (None, " ".join(base[:100])), (None, " ".join(base[3:100])),
    ]


@pytest.mark.parametrize("frequent, size", [(64, 1000), (5, 10)])
def test_against_brute_force(spark, monkeypatch, frequent, size):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "LIST", size)
    rows = odd()
    assert rows_of(ngram_join.classes(frame(spark, rows))) == brute(rows)


def test_texts_are_joined_where_ids_are_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAX_SENT", 0)
    rows = odd()[-60:]
    assert rows_of(ngram_join.classes(frame(spark, rows))) == brute(rows)


def one_group(seed):
    """Texts of one size and prefix, of which the last two link with each other but not with the lead; and one of its prefix's shingles."""
    r = random.Random(seed)
    while True:
        base, new = ([f"w{r.randrange(10**9)}" for _ in range(n)] for n in (24, 4))
        texts = [" ".join(base[:21] + end) for end in (base[21:], new[:3], new[:2] + new[3:])]
        sets = [hashing.shingles(pa.py_buffer(t.encode()), 5) for t in texts]
        nodes = [ngram_join._digest(s, len(s)) for s in sets]
        prefixes = {tuple(np.sort(s)[:6]) for s in sets}
        if {len(s) for s in sets} == {20} and len(prefixes) == 1 and nodes[0] == min(nodes):
            (prefix,) = prefixes
            windows = [" ".join(base[i:i + 5]) for i in range(17)]
            return texts, next(w for w in windows if hashing.shingles(pa.py_buffer(w.encode()), 5)[0] in prefix)


@pytest.mark.parametrize("beside", ["nothing", "another group", "many members"])
def test_members_of_one_group_that_link_past_its_lead(spark, beside):
    texts, window = one_group(5)
    rows = list(enumerate(texts))
    if beside == "another group":
        rows.append((9, window))
    if beside == "many members":
        r = random.Random(6)
        rows += [(100 + i, f"{' '.join(texts[1].split()[:21])} {r.randrange(3)} {r.randrange(3)} {r.randrange(3)}") for i in range(40)]
    want = brute(rows)
    assert want[2, 20, 1] == 1 and want[0, 20, 0] == 1
    assert rows_of(ngram_join.classes(frame(spark, rows))) == want


def test_one_of_each_class_stays(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u"), (4, None), (5, ""), (None, "a b c d e f")]
    df = frame(spark, rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 4, 5, None])


def test_long_words_of_one_polynomial_are_two(spark):
    # the two orders of Thue and Morse: sums of powers modulo 2**64 can't tell them apart
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2_048))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, f"v w {one} x y"), (4, f"v w {two} x y"), (5, one.upper()), (6, f"V w {two} x Y")]
    assert rows_of(ngram_join.classes(frame(spark, rows)).select("doc_id", "component_id")) == Counter(
        [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 4)]
    )


def test_empty(spark):
    assert ngram_join.classes(empty(spark)).count() == 0
    assert ngram_join.keep_one(empty(spark)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(7, 7), (None, 3), (1050, 1050)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["comp"] for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)}


def test_no_plan_computes_candidates_anew(spark, monkeypatch):
    # the driver holds each plan with all it stands on, several times over while stages end
    joins = {}

    def settled(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins[name] = max(joins.get(name, 0), len([line for line in plan.splitlines() if "Join " in line]))
        return settle(df, name)

    settle = ngram_join.settle
    monkeypatch.setattr(ngram_join, "settle", settled)
    assert ngram_join.classes(frame(spark, documents()[:60])).count() == 60
    assert max(joins.values()) <= 8, joins
