"""Nearest neighbours by inner product: inverted lists and an adaptive scan of dimensions.

Vectors get one more component that makes their lengths equal, so that the largest inner product
is the least distance. They are rotated and dealt to the list of their nearest centroid. A query scans
the lists nearest to it, a fixed share of them and more until they hold enough candidates. Within a list, vectors lie in blocks of columns: after each block the
distance so far, scaled to all dimensions, is tested against the distance of the worst neighbour found;
candidates that fail the test are abandoned, the others go on. Those that reach the end are scored
on the vectors as given.

Centroids are fitted on at most `SAMPLE` vectors, those of least hash; every vector is indexed. Lists
are cut into chunks and queries of a list into groups, so a list of any size is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm.base import settle
from postsieve.llm.vectors import rotation, usable

NEIGHBOURS = 20
SAMPLE = 16_384
MAX_LISTS = 1_024
#: Share of the lists that a query scans at least.
PROBED = 0.8
#: Columns in a block, and how far beyond its expectation a distance must be to be abandoned.
COLUMNS = 16
MARGIN = 2.1
CHUNK = 2_048
GROUP = 512
ROUNDS = 10
#: Share of a block's pairs that must be left for the next columns to be taken as products of whole blocks.
DENSE = 0.1
#: Queries whose least distances a task remembers from one list to the next.
REMEMBERED = 1 << 16
#: Rounding of a squared distance, as a share of the squared lengths it is computed from.
ROUNDING = 1e-12


def _lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of equal length, rotated."""
    more = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    lifted = np.concatenate([vectors, more[:, None]], axis=1)
    return lifted @ rotation(lifted.shape[1])


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """k-means of a sample."""
    chosen = sample[np.random.default_rng(0).permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        near = np.argmax(sample @ chosen.T - 0.5 * (chosen**2).sum(1), axis=1)
        order = np.argsort(near, kind="stable")
        held, begin = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(sample[order], begin, axis=0)
        chosen[held] = sums / np.diff(np.append(begin, len(order)))[:, None]
    return chosen


def scan(
    queries: np.ndarray, candidates: np.ndarray, same: np.ndarray, k: int, best: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that pass all tests, with k at least for each query where there are as many.

    `queries` and `candidates` are rotated and of equal length; pairs marked in `same` never pass. `best` holds the k
    least distances that each query has found elsewhere (infinite: none), and in the end those with these candidates.
    """
    dims = candidates.shape[1]
    n = len(candidates)
    if best is None:
        best = np.full((len(queries), k), np.inf)
    first = min(n, max(4 * k, 128))
    left, right, far = [], [], []
    own, held = (queries**2).sum(1), (candidates**2).sum(1)
    # distances are differences of squared lengths: near zero their rounding is larger than any share of them
    slack = ROUNDING * (own + held.max(initial=0))

    def meet(at: int, near: np.ndarray) -> None:
        """Note the distances to candidates from `at` on (infinite: abandoned), and tighten the distance to beat."""
        best[:] = np.partition(np.concatenate([best, near], axis=1), k - 1, axis=1)[:, :k]
        worst = best.max(1)
        q, c = np.nonzero((near <= (worst * (1 + 1e-9) + slack)[:, None]) & (near < np.inf))
        left.append(q)
        right.append(c + at)
        far.append(near[q, c])

    # the first candidates are measured in full and set the distance to beat
    near = own[:, None] + held[:first] - 2 * queries @ candidates[:first].T
    near[same[:, :first]] = np.inf
    meet(0, near)
    for at in range(first, n, 512):
        block = candidates[at:at + 512]
        worst = best.max(1)
        near = np.zeros((len(queries), len(block)))
        going = ~same[:, at:at + 512]
        d, pairs = 0, None
        while d < dims and (pairs is None or len(pairs[0])):
            e = min(d + COLUMNS, dims)
            margin = (1 + MARGIN / np.sqrt(e)) ** 2 * e / dims if e < dims else 1 + 1e-9
            limit = worst * margin + slack
            a, b = queries[:, d:e], block[:, d:e]
            if pairs is None:
                # while many go on, products of whole blocks cost less than picking pairs
                near += (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
                going &= near <= limit[:, None]
                if np.count_nonzero(going) < DENSE * going.size:
                    pairs = np.nonzero(going)
                    so_far = near[pairs]
            else:
                q, c = pairs
                so_far = so_far + ((a[q] - b[c]) ** 2).sum(1)
                go = so_far <= limit[q]
                pairs, so_far = (q[go], c[go]), so_far[go]
            d = e
        if pairs is None:
            near[~going] = np.inf
        else:
            near = np.full(going.shape, np.inf)
            near[pairs] = so_far
        meet(at, near)
    q, c, far = (np.concatenate(x) for x in (left, right, far))
    go = far <= best.max(1)[q] * (1 + 1e-9) + slack[q]
    return q[go], c[go]


def _index(model, probes: tuple[int, np.ndarray, int] | None = None):
    """Rows (id, vec, lists) with one list for a vector, or the lists that a query scans.

    probes: how many lists a query scans at least, the vectors in each list, and k. It goes on until
    its lists hold k vectors besides the `own` ones, those with its id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, chosen, dims = model.value
        for batch in batches:
            values = batch.column(1)
            vectors = np.asarray(values.flatten(), dtype=np.float64).reshape(-1, dims)
            if not len(vectors):
                continue
            turned = _lift(vectors, longest)
            if probes:
                turned = np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1) @ rotation(dims + 1)
            closeness = turned @ chosen.T - 0.5 * (chosen**2).sum(1)
            if probes:
                probed, sizes, k = probes
                nearest = np.argsort(-closeness, axis=1)
                needed = k + np.asarray(batch.column(2), dtype=np.int64)
                short = (np.cumsum(sizes[nearest], axis=1) < needed[:, None]).sum(1)
                lists = [near[:max(probed, n + 1)] for near, n in zip(nearest, short)]
            else:
                lists = list(np.argmax(closeness, axis=1)[:, None])
            packed = pa.array([v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), packed, pa.array(lists, pa.list_(pa.int64()))], names=["id", "vec", "lists"]
            )
    return run


def _search(model, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, _, dims = model.value
        turn = rotation(dims + 1)
        known, none = {}, np.full(k, np.inf)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, queries, other, vectors = (batch.column(i)[row].values for i in range(4))
                ids, other = np.asarray(ids, dtype=np.int64), np.asarray(other, dtype=np.int64)
                asked = np.frombuffer(b"".join(v.as_buffer() for v in queries)).reshape(-1, dims)
                held = np.frombuffer(b"".join(v.as_buffer() for v in vectors)).reshape(-1, dims)
                # a query has no part in the added dimension; all distances grow by the same
                point = np.concatenate([asked, np.zeros((len(asked), 1))], axis=1) @ turn
                # what a query found in this task's other lists is to be beaten in this one
                if len(known) > REMEMBERED:
                    known.clear()
                keys = [(i, v.as_py()) for i, v in zip(ids.tolist(), queries)]
                best = np.stack([known.get(key, none) for key in keys])
                q, c = scan(point, _lift(held, longest), ids[:, None] == other[None, :], k, best)
                known.update(zip(keys, best))
                score = np.einsum("ij,ij->i", asked[q], held[c])
                order = np.lexsort((other[c], -score, q))
                q, c, score = q[order], c[order], score[order]
                begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
                place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
                top = place < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[q[top]]), pa.array(other[c[top]]), pa.array(score[top])], names=["query", "id", "score"]
                )
    return run


def _chunked(df: DataFrame, size: int, names: tuple[str, str, str]) -> DataFrame:
    """(list, part, ids, vecs): each list's vectors in chunks of about `size`."""
    parts = df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    grouped = df.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")))
    return grouped.groupBy("list", "part").agg(F.collect_list(F.struct("id", "vec")).alias("all")).select(
        "list", F.col("part").alias(names[0]), F.col("all.id").alias(names[1]), F.col("all.vec").alias(names[2])
    )


def search(
    vectors: DataFrame, is_query: Column, *, ident: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS,
    probed: float = PROBED, lists: int | None = None, sample: int = SAMPLE,
) -> DataFrame:
    """The `k` nearest found of each row with `is_query`: query_id, rank, `ident`, score.

    Score is the inner product of the vectors as given, in double precision; ties go to the smaller
    id. Candidates are all rows with another id than the query's. Rows with a null id, vectors that are
    null, zero or hold null or non-finite components, and vectors of another length than most take no
    part. Equal rows are candidates of their own. An empty table gives an empty result; columns that
    `is_query` doesn't name are not read.
    """
    spark = vectors.sparkSession
    given = vectors.select(
        F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    # one row per length of vector
    length = given.groupBy(F.size("vector").alias("dims")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("square")
    ).orderBy(F.desc("n"), "dims").first()
    if length is None:
        return given.select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(ident), F.lit(0.0).alias("score")
        ).limit(0)
    dims, longest = length["dims"], float(np.sqrt(length["square"]))
    whole = given.where(F.size("vector") == dims)
    picked = whole.select("id", "vector", F.xxhash64("id", "vector").alias("h")).orderBy("h", "id").limit(sample).toArrow()
    fitted = _lift(np.asarray(picked.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dims), longest)
    count = lists or int(min(MAX_LISTS, max(1, np.sqrt(length["n"]))))
    chosen = centroids(fitted, min(count, len(fitted)))
    model = spark.sparkContext.broadcast((longest, chosen, dims))
    kind = "id long, vec binary, lists array<long>"
    indexed = whole.select("id", "vector").mapInArrow(_index(model), kind)
    # settled, so that a count of the lists doesn't rank them again
    flat = lambda df: settle(df, "search_ranked").select("id", "vec", F.explode("lists").alias("list"))
    candidates = settle(_chunked(flat(indexed), CHUNK, ("part", "ids", "vecs")), "search_lists")
    # one number per list
    sizes = np.zeros(len(chosen), np.int64)
    for row in candidates.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        sizes[row["list"]] = row["n"]
    own = whole.groupBy("id").agg(F.count("*").alias("own"))
    probes = max(1, int(np.ceil(probed * len(chosen)))), sizes, k
    asked = whole.where("asks").select("id", "vector").join(own, "id").select("id", "vector", "own").mapInArrow(
        _index(model, probes), kind
    )
    questions = settle(_chunked(flat(asked), GROUP, ("group", "asked", "asked_vecs")), "search_queries")
    met = questions.join(candidates, "list").select("asked", "asked_vecs", "ids", "vecs")
    found = met.mapInArrow(_search(model, k), "query long, id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), "rank", F.col("id").alias(ident), "score")
    )
