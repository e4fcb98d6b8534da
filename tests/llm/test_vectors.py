from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postsieve.llm import adaptive_search, subspace_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    given = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    out = [(int(i), [float(x) for x in v]) for i, v in given]
    r = np.random.default_rng(0)
    base = np.array(out[5][1])
    for j in range(150):
        v = base + r.normal(size=64) * r.choice([0.02, 0.04, 0.05, 0.06])
        out.append((1_000_000 + j, [float(np.float32(x)) for x in v * r.choice([0.5, 1, 3])]))
    out += [(1_100_000 + j, out[9][1]) for j in range(60)]
    return out + [
        (-1, None), (-2, [0.0] * 64), (-3, [float("nan")] + [1.0] * 63), (-4, [None] + [1.0] * 63),
        (-5, [float("inf")] + [1.0] * 63), (-6, [1.0] * 3), (-7, [1.0] * 3), (None, out[7][1]), (None, [5.0] * 64), (-8, []),
    ]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.selectExpr("*", "1 AS id", "2 AS node", "'x' AS score", "3 AS rank", "'l' AS label").repartition(5)


def usable(rows):
    return [
        i for i, (_, v) in enumerate(rows)
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]


@pytest.mark.parametrize("chunk", [2048, 50])
def test_near_duplicates_against_all_pairs(vectors, rows, chunk):
    ok = usable(rows)
    unit = np.array([rows[i][1] for i in ok])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(ok))
    for _ in range(len(ok)):
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ok))])
        if (new == label).all():
            break
        label = new
    groups = defaultdict(list)
    for p, i in enumerate(ok):
        groups[label[p]].append(i)
    want = Counter()
    for p, i in enumerate(ok):
        ids = [rows[j][0] for j in groups[label[p]] if rows[j][0] is not None]
        comp = min(ids) if ids else None
        want[rows[i][0], int(near[p].sum()), comp, rows[i][0] is not None and rows[i][0] == comp] += 1
    for i, (ident, v) in enumerate(rows):
        if i not in ok:
            want[(ident, 1, -7, ident == -7) if v == [1.0] * 3 else (ident, 0, ident, True)] += 1
    got = subspace_join.near_duplicates(vectors, chunk=chunk)
    assert Counter(map(tuple, got.collect())) == want


def test_search_against_all_products(vectors, rows):
    ok = [i for i in usable(rows) if rows[i][0] is not None]
    ids, held = np.array([rows[i][0] for i in ok]), np.array([rows[i][1] for i in ok])
    at = {int(a): j for j, a in enumerate(ids)}
    found = defaultdict(list)
    for q, rank, ident, score in adaptive_search.search(vectors, F.col("vec_id") % 20 == 0).collect():
        assert abs(held[at[ident]] @ held[at[q]] - score) < 1e-9 and q != ident
        found[q].append((rank, ident, score))
    asked = [int(a) for a in ids if a % 20 == 0]
    assert set(found) == set(asked)
    hits = 0
    for q in asked:
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        products = held @ held[at[q]]
        best = [int(ids[j]) for j in np.lexsort((ids, -products)) if ids[j] != q][:20]
        hits += len(set(best) & {g[1] for g in got})
    assert hits / (20 * len(asked)) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = table.select("vec_id", "embedding").toArrow()
    ids = got.column("vec_id").to_numpy()
    held = np.array(got.column("embedding").to_pylist(), dtype=float)
    asked = np.flatnonzero(ids % 20 == 0)
    products = held[asked] @ held.T
    products[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-products, axis=1)[:, :20]
    found = adaptive_search.search(table, F.col("vec_id") % 20 == 0).select("query_id", "vec_id").collect()
    want = {(int(ids[q]), int(ids[j])) for q, near in zip(asked, best) for j in near}
    assert len(want & set(map(tuple, found))) / len(want) >= 0.95


def test_vectors_of_one_hash_are_two(spark, vectors, rows, monkeypatch):
    want = Counter(map(tuple, subspace_join.near_duplicates(vectors).collect()))
    hashes = subspace_join._hashes
    monkeypatch.setattr(subspace_join, "_hashes", lambda v: (F.pmod(hashes(v)[0], F.lit(3)), hashes(v)[1]))
    assert Counter(map(tuple, subspace_join.near_duplicates(vectors).collect())) == want


def test_no_pair_of_packs_is_shuffled(vectors, monkeypatch):
    plans, settle = {}, subspace_join.settle

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return settle(df, name)

    monkeypatch.setattr(subspace_join, "settle", noted)
    monkeypatch.setattr(subspace_join, "PART_BYTES", 1 << 14, raising=False)
    subspace_join.near_duplicates(vectors, chunk=50)
    # before, both chunks of each pair went through two exchanges, so what was on disk grew with the square of the rows
    assert "Exchange" not in plans["vector_links"] and "CartesianProduct" in plans["vector_links"]
    # and each vector was written some ten times on its way there; now it is in one exchange and one table
    assert plans["vector_packs"].count("hashpartitioning") == 0 and plans["vector_packs"].count("rangepartitioning") == 1


@pytest.mark.parametrize(("tasks", "held"), [(20_000, 1 << 18), (3, 5)])
def test_many_packs(vectors, monkeypatch, tasks, held):
    want = Counter(map(tuple, subspace_join.near_duplicates(vectors).collect()))
    for name, value in (("PACK_BYTES", 7 * 256), ("PART_BYTES", 20 * 256), ("TASKS", tasks), ("HELD_ROWS", held), ("HELD_BYTES", 4_000)):
        monkeypatch.setattr(subspace_join, name, value)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = vectors.sparkSession.conf.get(key)
    assert Counter(map(tuple, subspace_join.near_duplicates(vectors, chunk=3).collect())) == want
    assert vectors.sparkSession.conf.get(key) == before


@pytest.mark.parametrize("least", [0.9, 0.35, 0.999])
def test_groups_far_apart_and_vectors_of_other_lengths(spark, monkeypatch, least):
    r = np.random.default_rng(4)
    # long vectors that fix a rotation, in groups that vary in few directions; short and single ones have none of their own
    centres = r.normal(size=(12, 24)) * np.arange(1, 25) ** -0.7
    held = [centres[r.integers(12)] + r.normal(size=24) * r.choice([0.01, 0.05, 0.1]) for _ in range(500)]
    held += [r.normal(size=3) * 10.0 ** r.integers(-200, 200) for _ in range(120)]
    held += [np.array([x]) for x in (1.0, -2.0, 5e-324, 1e300)] + [held[i] for i in (1, 3, 3, 7, 505)] + [np.ones(9)]
    monkeypatch.setattr(subspace_join, "PACK_BYTES", 40 * 8 * 24)
    monkeypatch.setattr(subspace_join, "PART_BYTES", 90 * 8 * 24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "vec_id long, embedding array<double>").repartition(4)
    unit = [v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for v in held]
    near = np.array([[len(u) == len(v) and i != j and u @ v >= least for j, v in enumerate(unit)] for i, u in enumerate(unit)])
    got = {row["vec_id"]: row for row in subspace_join.near_duplicates(df, least=least, chunk=16).collect()}
    assert [got[i]["n_links"] for i in range(len(held))] == near.sum(1).tolist()
    label = np.arange(len(held))
    for _ in range(len(held)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(held))])
    assert [got[i]["component_id"] for i in range(len(held))] == label.tolist()


def test_equal_vectors_have_one_place_in_any_batch():
    r = np.random.default_rng(5)
    given = r.normal(size=(700, 40)).astype(np.float32)
    for sample in (given[:300], given[:30], given[:0]):
        lead = subspace_join.Lead(40, sample, 0.9)
        whole = lead.places(given)
        assert len(np.unique(whole)) > 500
        assert all((lead.places(given[a:b]) == whole[a:b]).all() for a, b in ((0, 1), (1, 4), (5, 300), (333, 700)))


def test_copies_of_a_query_are_not_lost_to_rounding():
    r = np.random.default_rng(1)
    for queries in (1, 40, 512):
        for _ in range(5):
            given = r.normal(size=(900, 64))
            given = (given / np.linalg.norm(given, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
            given[::3] = given[0]
            longest = float(np.sqrt((given**2).sum(1).max()))
            point = np.concatenate([np.repeat(given[:1], queries, 0), np.zeros((queries, 1))], axis=1) @ adaptive_search.rotation(65)
            q, c = adaptive_search.scan(point, adaptive_search._lift(given, longest), np.zeros((queries, 900), bool), 20)
            assert all(set(range(0, 900, 3)) <= set(c[q == i]) for i in range(queries))


def test_small_tables_give_all_candidates(spark):
    # three lists; the query's id stands on many rows, which are no candidates
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(1, 12)] + [(0, [float(x) for x in r.normal(size=8)])] * 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (3, 11, 20):
        got = adaptive_search.search(df, F.col("vec_id").isin(1, 2, 3), k=k, lists=3).groupBy("query_id").count().collect()
        assert {q["query_id"]: q["count"] for q in got} == dict.fromkeys((1, 2, 3), min(k, 14))
    got = adaptive_search.search(df.dropDuplicates(["vec_id"]), F.col("vec_id") < 20, k=20, lists=3).groupBy("query_id").count().collect()
    assert [q["count"] for q in got] == [11] * 12
    one = df.dropDuplicates(["vec_id"]).selectExpr("*", "vec_id = 0 AS asks")
    many = one.unionAll(df.where("vec_id = 0").selectExpr("*", "false AS asks"))
    assert adaptive_search.search(many, F.col("asks"), k=11, lists=3).select("vec_id").distinct().count() == 11


def test_few_and_no_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    three = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 0.0]), (20, [1.0, 2.0])], schema)
    got = sorted(map(tuple, adaptive_search.search(three, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 20, 5.0), (0, 2, 1, 4.0), (20, 1, 0, 5.0), (20, 2, 1, 4.0)]
    none = three.where("vec_id = 2")
    assert adaptive_search.search(none, F.col("vec_id") % 20 == 0).count() == 0
    assert adaptive_search.search(three.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert [tuple(r) for r in subspace_join.near_duplicates(none).collect()] == [(2, 0, 2, True)]
    assert subspace_join.near_duplicates(three.limit(0)).count() == 0


@pytest.mark.parametrize("n", [900, 2_048])
def test_a_scan_passes_few_more_than_asked_for(n):
    r = np.random.default_rng(1)
    given, asked = r.normal(size=(n, 32)), r.normal(size=(60, 32))
    longest = np.sqrt((given**2).sum(1).max())
    turn = adaptive_search.rotation(33)
    point = np.concatenate([asked, np.zeros((60, 1))], axis=1) @ turn
    lifted, same = adaptive_search._lift(given, longest), np.zeros((60, n), bool)
    q, c = adaptive_search.scan(point, lifted, same, 20)
    # before, all that beat the first candidates
    assert 60 * 20 <= len(q) <= 60 * 22
    best = np.argsort(-(asked @ given.T), axis=1)[:, :20]
    found = set(zip(q.tolist(), c.tolist()))
    assert np.mean([(i, j) in found for i in range(60) for j in best[i].tolist()]) >= 0.97
    # distances found elsewhere are to be beaten
    none = np.full((60, 20), 1e-6)
    assert len(adaptive_search.scan(point, lifted, same, 20, none)[0]) == 0
