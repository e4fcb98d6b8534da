"""Near duplicates of embeddings by a range join in a subspace of rotated dimensions.

Vectors of length 1 have a cosine of at least t exactly if their squared distance is at most
2 - 2 t, and their distance in a subspace is never more than that in the whole. Vectors are rotated so
that a few leading dimensions tell most of them apart: a sample fixes the rotation (the directions in
which it varies most) and how many dimensions lead; whatever is chosen, no pair is missed. Vectors
are sorted by a place, bits of cells in the leading dimensions, and packed in that order, each once. Packs, and chunks
within a pack, whose bounds in the leading dimensions lie too far apart do not meet; others are compared
in the leading dimensions, and what is near there is verified on the vectors as given.

Packs meet where they are read: a task reads some packs on either side of the join, so no pair
of packs is shuffled or written, and what is on disk grows with the rows alone. Pairs never leave their task:
a task counts each vector's links and returns, for the components, one edge per vector that
joins its local component. Equal vectors are one before that.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from postsieve.llm.base import settle
from postsieve.llm.graph import components
from postsieve.llm.vectors import rotation, usable

LEAST_COSINE = 0.9
CHUNK = 2_048
#: Vectors of either side that are compared at once.
STRIP = 512
#: Vectors that fix the rotation, about twice as many and `SAMPLED` components at most; longer vectors than `WIDEST` keep the fixed one.
SAMPLE = 1_024
SAMPLED = 1 << 20
WIDEST = 256
#: Leading dimensions beyond those that tell all pairs of the sample apart that are not near.
SPARE = 4
#: Bits of a place, and of one dimension in it.
BITS = 24
CELL_BITS = 8
#: What tells vectors apart, and bytes of them in a pack and in a file of packs; tasks of the join, pairs of packs
#: that go to Python at once, and leading dimensions in the join's condition.
KEY = ["h", "back"]
PACK_BYTES = 4 << 20
PART_BYTES = 8 << 20
TASKS = 10_000
AT_ONCE = 2
BOUNDS = 16
#: Rows that a task returns are summed up when they are so many, and leading dimensions of so many bytes are kept.
HELD_ROWS = 1 << 18
HELD_BYTES = 24 << 20
#: Share of a strip's pairs from which on whole columns are verified.
DENSE = 0.02
#: Rounding of a squared distance of single floats, and for each dimension.
_SLACK = (1e-4, 3e-7)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _reach(least: float, lead: int) -> float:
    """The squared distance in `lead` dimensions of single floats that no linked pair exceeds."""
    return 2 - 2 * least + _SLACK[0] + _SLACK[1] * lead


class Lead:
    """The leading dimensions of vectors of one length: a rotation to them, and cells for the places."""

    def __init__(self, dims: int, sample: np.ndarray, least: float):
        unit = _unit(sample.astype(np.float64)) if len(sample) else np.zeros((0, dims))
        self.turn = None
        if dims <= WIDEST and len(unit) >= 2 * dims:
            across = np.linalg.eigh(np.cov(unit, rowvar=False).reshape(dims, dims))[1]
            self.turn = np.ascontiguousarray(across[:, ::-1])
        self.dims = self.count = dims
        turned = unit @ self.full()
        if len(unit) > 1:
            upper = np.triu_indices(len(unit), 1)
            near = np.zeros(len(upper[0]), np.float32)
            bound, own = 2 - 2 * least, np.flatnonzero((unit @ unit.T)[upper] < least)
            for last in range(2, dims, 2):
                part = turned[:, last - 2:last]
                square = (part * part).sum(1)
                near += (square[:, None] + square[None] - 2 * part @ part.T)[upper]
                if not (near[own] <= bound).any():
                    self.count = min(dims, last + SPARE)
                    break
        turned = turned[:, : self.count]
        if self.turn is not None:
            self.turn = self.turn[:, : self.count]
        # a bit goes to the dimension whose cells are the widest so far
        width = turned.std(0) if len(turned) > 1 else np.ones(self.count)
        bits = np.zeros(self.count, int)
        self.order = []
        for _ in range(BITS):
            j = int(np.argmax(np.where(bits < CELL_BITS, width, -1)))
            if bits[j] == CELL_BITS:
                break
            self.order.append((j, int(bits[j])))
            bits[j] += 1
            width[j] /= 2
        self.cells = {
            j: np.quantile(turned[:, j], np.arange(1, 1 << bits[j]) / (1 << bits[j])) if len(turned) else np.zeros(1)
            for j in np.flatnonzero(bits).tolist()
        }
        self.bits = bits

    def full(self) -> np.ndarray:
        return rotation(self.dims) if self.turn is None else self.turn

    def leading(self, vectors: np.ndarray) -> np.ndarray:
        return (_unit(vectors.astype(np.float64)) @ self.full()[:, : self.count]).astype(np.float32)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """The same place for equal vectors wherever they stand: products are summed one dimension after another."""
        unit, turn, used = _unit(vectors.astype(np.float64)), self.full(), list(self.cells)
        at = np.zeros((len(vectors), len(used)))
        for d in range(self.dims):
            at += unit[:, d:d + 1] * turn[d, used]
        cell = {j: np.searchsorted(self.cells[j], at[:, k]) for k, j in enumerate(used)}
        place = np.zeros(len(vectors), np.int64)
        for j, bit in self.order:
            place = 2 * place + (cell[j] >> (self.bits[j] - 1 - bit) & 1)
        return place


def leads(held: DataFrame, rows: int, values: int, least: float) -> dict[int, Lead]:
    """By length of the vectors, from those whose hashes have a certain rest. What it reads only sets how fast the join is."""
    hashed = held.select("vector", *[h.alias(k) for k, h in zip(KEY, _hashes(F.col("vector")))])
    some = hashed.where((F.pmod("back", F.lit(max(1, rows // SAMPLE))) == 0) & usable(F.col("vector")))
    most = min(2 * SAMPLE, max(64, SAMPLED // max(1, values // max(1, rows))))
    found: dict[int, list] = {}
    for row in some.dropDuplicates(KEY).select("vector").limit(most).collect():
        found.setdefault(len(row["vector"]), []).append(row["vector"])
    return {dims: Lead(dims, np.array(sorted(vectors), np.float64), least) for dims, vectors in found.items()}


def _lead(known: dict[int, Lead], dims: int, least: float) -> Lead:
    if dims not in known:
        known[dims] = Lead(dims, np.zeros((0, dims)), least)
    return known[dims]


def _places(known: dict[int, Lead], least: float):
    """Rows (dims, place, h, back, ids, vec) of the distinct vectors of each batch; vec as bytes. Vectors that link with
    nothing have no dimensions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, values = batch.column(0), np.stack([np.asarray(batch.column(k)) for k in (1, 2)], axis=1), batch.column(3)
            offsets, child = np.asarray(values.offsets), values.values
            flat = np.asarray(child.fill_null(pa.scalar(np.nan, child.type)) if child.null_count else child)
            size = np.where(np.asarray(values.is_valid()), np.diff(offsets), 0)
            alone = np.ones(len(size), bool)
            for dims in np.unique(size[size > 0]):
                some = np.flatnonzero(size == dims)
                vectors = flat[offsets[some][:, None] + np.arange(dims)]
                fit = np.isfinite(vectors).all(1) & vectors.any(1)
                some, vectors = some[fit], vectors[fit]
                alone[some] = False
                if not len(some):
                    continue
                _, rows, group, copies = np.unique(keys[some], axis=0, return_index=True, return_inverse=True, return_counts=True)
                own = ids.take(pa.array(some[np.argsort(group.ravel(), kind="stable")]))
                vectors = vectors[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), dims, np.int32)), pa.array(_lead(known, int(dims), least).places(vectors)),
                     *[pa.array(keys[some[rows], k]) for k in (0, 1)],
                     pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(copies)).astype(np.int32)), own),
                     pa.array([v.tobytes() for v in vectors], pa.binary())],
                    names=["dims", "place", "h", "back", "ids", "vec"],
                )
            if alone.any():
                own = ids.filter(pa.array(alone))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), *[pa.array([0], pa.int64())] * 2,
                     pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([b""], pa.binary())],
                    names=["dims", "place", "h", "back", "ids", "vec"],
                )
    return run


PACKS = "pack long, dims int, low array<double>, high array<double>, copies array<long>, vecs binary, nodes array<long>, ids array<long>"


def _packs(known: dict[int, Lead], least: float, chunk: int, kind: type):
    """Rows (pack, dims, low, high, copies, vecs) of consecutive vectors of one length, where the node of a vector is its
    pack's number plus its place in it; and rows (nodes, ids) that tell which ids stand for a node, null for vectors that link with
    nothing. Of rows in order of their keys."""
    types = {
        "pack": pa.int64(), "dims": pa.int32(), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64()),
        "copies": pa.list_(pa.int64()), "vecs": pa.binary(), "nodes": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()),
    }

    def row(**given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([given.get(k)], t) if not isinstance(given.get(k), pa.Array)
             else pa.ListArray.from_arrays(pa.array([0, len(given[k])], pa.int32()), given[k]) for k, t in types.items()],
            names=list(types),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, last = TaskContext.get().partitionId() << 40, None
        # of the pack to come: its first node, the length of its vectors, how many it holds at most, and their copies and bytes
        first = dims = most = 0
        copies: list[int] = []
        vecs: list[pa.Buffer] = []

        def pack() -> pa.RecordBatch:
            packed = b"".join(vecs)
            lead = _lead(known, dims, least).leading(np.frombuffer(packed, kind).reshape(len(vecs), dims))[:, :BOUNDS]
            out = row(pack=first, dims=dims, low=lead.min(0).astype(float), high=lead.max(0).astype(float),
                      copies=pa.array(copies, pa.int64()), vecs=packed)
            copies.clear()
            vecs.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in ("dims", "h", "back")], axis=1)
            fresh = np.append(last is None or (keys[0] != last).any(), (keys[1:] != keys[:-1]).any(1))
            last = keys[-1]
            ids = batch.column("ids")
            sizes = np.diff(np.asarray(ids.offsets))
            owner = node + np.cumsum(fresh) - 1
            node = int(owner[-1]) + 1
            yield row(nodes=pa.array(np.repeat(owner, sizes), mask=np.repeat(keys[:, 0] == 0, sizes)), ids=ids.flatten())
            starts = np.flatnonzero(fresh)
            if copies and (not len(starts) or starts[0]):
                copies[-1] += int(sizes[: starts[0] if len(starts) else None].sum())
            totals = np.add.reduceat(sizes, starts).tolist() if len(starts) else []
            vec = batch.column("vec")
            for start, total in zip(starts.tolist(), totals):
                size = int(keys[start, 0])
                if vecs and (size != dims or len(vecs) == most):
                    yield pack()
                if not size:
                    continue
                if not vecs:
                    first, dims = int(owner[start]), size
                    most = max(1, PACK_BYTES // (dims * np.dtype(kind).itemsize))
                    most = min(most, max(chunk, most // chunk * chunk))
                copies.append(total)
                vecs.append(vec[start].as_buffer())
        if vecs:
            yield pack()
    return run


class Pack:
    """Vectors of a pack as given, with their leading dimensions and the bounds of its chunks in them."""

    def __init__(self, first: int, copies: np.ndarray, vectors: np.ndarray, lead: np.ndarray, chunk: int):
        self.first, self.copies, self.vectors, self.lead = first, copies, vectors, lead
        self.square = (lead * lead).sum(1)
        self.parts = [slice(i, min(i + chunk, len(lead))) for i in range(0, len(lead), chunk)]
        self.low = np.array([lead[p].min(0) for p in self.parts])
        self.high = np.array([lead[p].max(0) for p in self.parts])


def _merged(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Labels after positions `one` and `two` are linked pair by pair; a label is the least position of its component."""
    while True:
        a, b = label[one], label[two]
        apart = a != b
        if not apart.any():
            return label
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _verified(u: np.ndarray, v: np.ndarray, one: np.ndarray, two: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (row `one` of u, row `two` of v) whose vectors have a cosine of at least `least`."""
    if len(one) > DENSE * len(u) * len(v):
        rows, columns = np.unique(one), np.unique(two)
        asked = np.zeros((len(u), len(v)), bool)
        asked[one, two] = True
        whole = _unit(u[rows].astype(np.float64)) @ _unit(v[columns].astype(np.float64)).T
        one, two = np.nonzero(asked[np.ix_(rows, columns)])
        cosine, one, two = whole[one, two], rows[one], columns[two]
    else:
        cosine = np.einsum("ij,ij->i", _unit(u[one].astype(np.float64)), _unit(v[two].astype(np.float64)))
    for k in np.flatnonzero(np.abs(cosine - least) < 1e-9):
        a, b = u[one[k]].astype(np.float64), v[two[k]].astype(np.float64)
        cosine[k] = (a @ b) / np.sqrt((a @ a) * (b @ b))
    near = cosine >= least
    return one[near], two[near]


def compare(own: Pack, other: Pack, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a pair of packs that link: (node, links, root of its local component). A pack meets itself if both are the same."""
    same = own is other
    n, m, lead = len(own.lead), len(other.lead), own.lead.shape[1]
    reach = np.float32(_reach(least, lead))
    shift = 0 if same else n
    links, label = np.zeros(n if same else n + m, np.int64), np.arange(n if same else n + m)
    room = np.empty(STRIP * STRIP, np.float32)
    for i, part in enumerate(own.parts):
        # squared distances less the reach are products: (-2 a, a a - reach, 1) (b, 1, b b)
        left = np.empty((part.stop - part.start, lead + 2), np.float32)
        left[:, :lead], left[:, lead], left[:, lead + 1] = -2 * own.lead[part], own.square[part] - reach, 1
        for j, across in enumerate(other.parts):
            if same and j < i:
                continue
            gap = np.maximum(np.maximum(own.low[i] - other.high[j], other.low[j] - own.high[i]), 0)
            if gap @ gap > reach:
                continue
            held = other.lead[across]
            gap = np.maximum(np.maximum(own.low[i] - held, held - own.high[i]), 0)
            columns = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= reach)
            if not len(columns):
                continue
            columns += across.start
            met = other.vectors[across] if len(columns) == len(held) else other.vectors[columns]
            right = np.empty((len(columns), lead + 2), np.float32)
            right[:, :lead], right[:, lead], right[:, lead + 1] = other.lead[columns], 1, other.square[columns]
            for at, over in itertools.product(range(0, len(left), STRIP), range(0, len(right), STRIP)):
                a, b = left[at:at + STRIP], right[over:over + STRIP]
                far = np.matmul(a, b.T, out=room[: len(a) * len(b)].reshape(len(a), len(b)))
                if far.min() > 0:
                    continue
                rows = np.flatnonzero(far.min(1) <= 0)
                one, two = np.nonzero(far[rows] <= 0)
                one = rows[one]
                begin, facing = part.start + at, columns[over:over + STRIP]
                if same and i == j:
                    ahead = begin + one < facing[two]
                    one, two = one[ahead], two[ahead]
                one, two = _verified(own.vectors[begin:begin + len(a)], met[over:over + STRIP], one, two, least)
                if len(one):
                    one, two = one + begin, facing[two]
                    np.add.at(links, one, other.copies[two])
                    np.add.at(links, two + shift, own.copies[one])
                    label = _merged(label, one, two + shift)
    nodes = own.first + np.arange(n)
    nodes = nodes if same else np.concatenate([nodes, other.first + np.arange(m)])
    some = links > 0
    return nodes[some], links[some], nodes[label[some]]


def _pairs(known: dict[int, Lead], least: float, chunk: int, kind: type):
    """Rows (node, links, root) of pairs of packs: those of a task are summed up by node, with the root of its component in all of them."""
    def summed(found: list) -> pa.RecordBatch:
        node, links, root = (np.concatenate([f[k] for f in found]) for k in range(3))
        every, at = np.unique(np.concatenate([node, root]), return_inverse=True)
        node, root = at[: len(node)], at[len(node):]
        label = _merged(np.arange(len(every)), node, root)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, node, links)
        return pa.RecordBatch.from_arrays([pa.array(every), pa.array(total), pa.array(every[label])], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leading: dict[int, np.ndarray] = {}
        found, rows = [], 0

        def pack(batch: pa.RecordBatch, at: int, row: int, dims: int) -> Pack:
            first = batch.column(at)[row].as_py()
            copies = np.asarray(batch.column(at + 1)[row].values, dtype=np.int64)
            vectors = np.frombuffer(batch.column(at + 2)[row].as_buffer(), kind).reshape(len(copies), dims)
            if first not in leading:
                if sum(x.nbytes for x in leading.values()) > HELD_BYTES:
                    leading.clear()
                leading[first] = _lead(known, dims, least).leading(vectors)
            return Pack(first, copies, vectors, leading[first], chunk)

        for batch in batches:
            for row in range(batch.num_rows):
                dims = batch.column(0)[row].as_py()
                own = pack(batch, 1, row, dims)
                same = batch.column(4)[row].as_py() == own.first
                result = compare(own, own if same else pack(batch, 4, row, dims), least)
                if len(result[0]):
                    found.append(result)
                    rows += len(result[0])
                if rows > HELD_ROWS:
                    yield summed(found)
                    found, rows = [], 0
        if found:
            yield summed(found)
    return run


def _hashes(vector: Column) -> tuple[Column, Column]:
    return F.xxhash64(vector), F.xxhash64(F.reverse(vector))


@contextmanager
def _rows_at_once(spark: SparkSession, rows: int):
    """Plans made meanwhile give Python so many rows at once; a pair of packs is a wide row."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _meeting(packs: DataFrame, least: float) -> DataFrame:
    """Pairs of packs that may hold links, each once; nothing is shuffled: both sides are read where they meet."""
    columns = ("pack", "copies", "vecs", "dims", "low", "high")
    one, two = (packs.select(*[F.col(c).alias(f"{c}_{k}") for c in columns]) for k in ("one", "two"))
    parts = packs.rdd.getNumPartitions()
    if parts * parts > TASKS:
        one = one.coalesce(max(1, TASKS // parts))

    def over(low: str, high: str) -> Column:
        return F.zip_with(low, high, lambda a, b: a - b)

    gaps = F.zip_with(over("low_one", "high_two"), over("low_two", "high_one"), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap) <= _reach(least, BOUNDS)
    met = one.hint("shuffle_replicate_nl").join(
        two, (F.col("pack_one") <= F.col("pack_two")) & (F.col("dims_one") == F.col("dims_two")) & near
    )
    return met.select(F.col("dims_one").alias("dims"), *[f"{c}_{k}" for k in ("one", "two") for c in columns[:3]])


def near_duplicates(
    vectors: DataFrame, *, ident: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE, chunk: int = CHUNK,
) -> DataFrame:
    """One row per vector: `ident`, n_links, component_id and kept.

    n_links: other vectors with a cosine of at least `least`; component_id: the smallest id
    reachable by links, its own included; kept: whether that is its own id. All pairs are found. Vectors that
    are null, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths. Ids only name the rows: repeated ids are vectors of their own, null ids are no component's
    id (component_id is null and kept false where there is no other). An empty table gives an
    empty result; other columns are not read.
    """
    given = vectors.schema[vector].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    kind = np.float32 if single else np.float64
    held = vectors.select(
        F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector")
    )
    rows, values = held.agg(F.count("vector"), F.coalesce(F.sum(F.when(F.col("vector").isNotNull(), F.size("vector"))), F.lit(0))).first()
    known = leads(held, rows, values, least)
    parts = max(1, -(-values * np.dtype(kind).itemsize // PART_BYTES))
    # equal vectors are one node; they are told apart by 128 bits
    order = ["dims", "place", *KEY]
    written = settle(
        held.select("id", *[h.alias(k) for k, h in zip(KEY, _hashes(F.col("vector")))], "vector")
        .mapInArrow(_places(known, least), "dims int, place long, h long, back long, ids array<long>, vec binary")
        .repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_packs(known, least, chunk, kind), PACKS),
        "vector_packs",
    )
    packs = written.where(F.col("pack").isNotNull())
    ids = written.where(F.col("ids").isNotNull()).select(F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("ids").alias("id"))))
    more = packs.select("pack", F.posexplode("copies").alias("pos", "copies")).where("copies > 1").select(
        (F.col("pack") + F.col("pos")).alias("node"), (F.col("copies") - 1).alias("copies")
    )
    with _rows_at_once(vectors.sparkSession, AT_ONCE):
        found = settle(
            _meeting(packs, least).mapInArrow(_pairs(known, least, chunk, kind), "node long, links long, root long"), "vector_links"
        )
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found, "node", "root")
    named = ids.where(F.col("node").isNotNull()).join(more, "node", "left").join(counts, "node", "left").join(comps, "node", "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("comp"),
    )
    linked = named.where("n_links > 0")
    alone = named.where("n_links = 0").select("id", "n_links").unionAll(ids.where(F.col("node").isNull()).select("id", F.lit(0)))
    smallest = linked.groupBy("comp").agg(F.min("id").alias("component_id"))
    return linked.join(smallest, "comp").select("id", "n_links", "component_id").unionAll(
        alone.withColumn("component_id", F.col("id"))
    ).select(
        F.col("id").alias(ident), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
