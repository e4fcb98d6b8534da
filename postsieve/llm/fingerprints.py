"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius by permuted block tables.

A document's terms are its shingles of five words (A-Z in lower case). Each has a hash of 128 signed bits and a
weight, the square root of how often it occurs; for each bit the terms vote with their weights, and the sign of
the sum is the fingerprint's bit. Texts with no term have all bits 0. Two fingerprints agree in a share of bits that
falls with the angle between the documents' weighted terms: 1 for equal texts, about half for unrelated ones.

`near` counts for every fingerprint the documents within a radius. Two fingerprints that differ in `radius` bits
at most have at least m of radius + m blocks in common, whichever these are. So there is a table for each choice
of m blocks, and those blocks are its key (the leading bits of a permuted fingerprint). Rows of equal key meet in a task and are
compared there in numpy; a pair counts in the first table it meets in. Nothing is left out: m decides only how
many tables there are and how long their lists, and long lists are split into squares of parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.llm import hashing
from postsieve.llm.base import settle

BITS = 128
RADIUS = 6
_DIGITS = BITS // 4
#: Terms whose votes are counted at once, and documents that leave a task's Python in one batch.
_TERMS, _BATCH = 8192, 256
#: Rows of a list that are compared with each other in one place.
PART = 2048
#: Tables: with more fingerprints keys take more blocks, as long as there are at most this many.
MAX_TABLES = 84
_U = np.uint64
#: What makes a second hash of the first.
_SECOND = _U(0x9E3779B97F4A7C15)


def fingerprint(text: bytes | None) -> bytes:
    """The 16 bytes of a text's fingerprint."""
    terms = hashing.shingle_hashes(text)
    if not len(terms):
        return bytes(BITS // 8)
    terms, counts = np.unique(terms, return_counts=True)
    weights = np.sqrt(counts).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for i in range(0, len(terms), _TERMS):
        part = terms[i:i + _TERMS]
        both = np.stack([part, hashing.mix(part ^ _SECOND)], axis=1)
        bits = np.unpackbits(both.view(np.uint8), axis=1).astype(np.float32)
        weight = weights[i:i + _TERMS]
        votes += 2 * (weight @ bits) - weight.sum(dtype=np.float32)
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of bits in which two fingerprints agree."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def add_fingerprints(docs: DataFrame, keep: Sequence[str] = (), text: str = "text") -> DataFrame:
    """`keep` columns and `fingerprint`, 32 hexadecimal digits, of every row's whole text; no shuffle.

    Null counts as empty; an empty text, or one of blanks, has the fingerprint of zeros. Equal texts have equal
    fingerprints. Columns that are not kept, whatever their names, play no part.
    """
    kept = list(keep)
    schema = T.StructType([docs.schema[name] for name in kept] + [T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(v.as_py()).hex() for v in batch.column(len(kept)).cast(pa.binary())]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints, pa.string())], names=[*kept, "fingerprint"])

    return docs.select(*kept, docs[text].alias("_text")).mapInArrow(run, schema)


# --- how much of a fingerprint an edit leaves -----------------------------------------------------

_TRIAL = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def edit_trial(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document its fingerprint, that of its text with the second half overwritten by the next document, and both likenesses.

    The next document is the one with the next smaller id; the last has the first as its next. Documents of equal
    id follow each other by a hash of their texts, null ids come last, and a table of one row is its own next. The last
    floor(n_chars / 2) code points give way to as many first ones of the next text, or to all of it. Null
    texts are empty.

    Texts move once, dealt out by range of id; neighbours meet in their range. Only a range's first and last
    document are written with their texts, and meet those of the ranges beside it by number.
    """
    keyed = docs.select(
        F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumns({"h": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    # equal rows are told apart by `tie`, so that any number of them is spread over ranges
    order = [F.col("id").desc_nulls_last(), F.col("h"), F.col("tie")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "id", "text", F.spark_partition_id().alias("part")
    )
    kind = docs.schema[ident].dataType.simpleString()
    tried = settle(ranged.mapInArrow(_within, f"id {kind}, part int, role int, text string, {_TRIAL}"), "edit_trials")
    firsts = tried.where("role = 1").select("part", F.col("text").alias("next_text"))
    # one number per range
    parts = tried.where("role = 1").select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    after = parts.select("part", following.alias("next_part"))
    lasts = tried.where("role = 2").select("id", "text", "part").join(after, "part").join(
        firsts.withColumnRenamed("part", "next_part"), "next_part"
    ).select("id", "text", "next_text")
    columns = [name.split()[0] for name in _TRIAL.split(", ")]
    both = tried.where("role = 0").select("id", *columns).unionAll(
        lasts.mapInArrow(_across, f"id {kind}, {_TRIAL}")
    )
    return both.withColumnRenamed("id", ident)


def _trial(text: bytes, following: bytes, known: dict[bytes, bytes]) -> tuple:
    import hashlib

    whole = text.decode("utf-8", "replace")
    half = len(whole) // 2
    # half as many code points take at most four bytes each
    edited = (whole[:len(whole) - half] + following[:4 * half].decode("utf-8", "ignore")[:half]).encode()
    own, other = (known.get(t) or known.setdefault(t, fingerprint(t)) for t in (text, following))
    changed = fingerprint(edited)
    return (
        len(whole), hashlib.sha256(edited).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, other)
    )


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trials of all rows but the last; the first and the last row with their texts (roles 1 and 2)."""
    before, part, rows = None, None, []
    known: dict[bytes, bytes] = {}
    kind = None

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows))
        types = [kind, pa.int32(), pa.int32(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        names = ["id", "part", "role", "text", *[name.split()[0] for name in _TRIAL.split(", ")]]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        rows.clear()
        return out

    for incoming in batches:
        kind = incoming.column(0).type
        for ident, value in zip(incoming.column(0).to_pylist(), incoming.column(1).cast(pa.binary())):
            text = value.as_py()
            if before is None:
                part = incoming.column(2)[0].as_py()
                rows.append((None, part, 1, text, *[None] * 6))
            else:
                rows.append((before[0], part, 0, None, *_trial(before[1], text, known)))
                known = {text: known[text]}
            before = ident, text
            if len(rows) >= _BATCH:
                yield batch()
    if before is not None:
        rows.append((before[0], part, 2, before[1], *[None] * 6))
        yield batch()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist())
        rows = list(zip(*[_trial(text, following, {}) for text, following in texts]))
        types = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        columns = [pa.array(c, t) for c, t in zip(rows, types)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *columns], names=["id", *[name.split()[0] for name in _TRIAL.split(", ")]]
        )


# --- all fingerprints within a radius -------------------------------------------------------------

def blocks(radius: int, matching: int) -> list[tuple[int, int]]:
    """(first digit, digits) of radius + matching blocks of the hexadecimal digits, as equal as can be."""
    count = radius + matching
    edges = [round(i * _DIGITS / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _matching(radius: int, rows: int) -> int:
    """How many blocks make a key: as many as keep a list to about 16 chance rows, in so many tables at most."""
    wanted, m = max(math.log2(max(rows, 1)) - 4, 1), 1
    while m * BITS / (radius + m) < wanted and math.comb(radius + m + 1, m + 1) <= MAX_TABLES and radius + m < _DIGITS:
        m += 1
    return m


def near(prints: DataFrame, radius: int = RADIUS, fingerprint: str = "fingerprint") -> DataFrame:
    """One row per distinct fingerprint: `fingerprint`, `n_docs` that have it and `n_near`, the documents that have another
    one in which at most `radius` bits differ (0 to 15).

    Equal fingerprints are one row from the start, however many documents share them. Null fingerprints count as
    none and get no row.
    """
    if not 0 <= radius < 16:
        raise ValueError("radius must be 0 to 15 bits")
    nodes = settle(
        prints.select(F.col(fingerprint).alias("fp")).where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n")), "prints"
    )
    matching = _matching(radius, nodes.count())
    places = blocks(radius, matching)
    choices = list(combinations(range(len(places)), matching))
    keys = F.array(*[
        F.struct(F.lit(i).alias("table"), F.concat(*[F.substring("fp", places[b][0] + 1, places[b][1]) for b in chosen]).alias("key"))
        for i, chosen in enumerate(choices)
    ])
    listed = nodes.select(F.unhex("fp").alias("fp"), "n", F.inline(keys))
    # lists longer than a part are few: at most the rows by the length of a part
    long = listed.groupBy("table", "key").count().where(F.col("count") > PART).select(
        "table", "key", F.ceil(F.col("count") / PART).cast("int").alias("parts")
    )
    dealt = listed.join(long, ["table", "key"], "left").select(
        "table", "key", "fp", "n", F.coalesce("parts", F.lit(1)).alias("parts")
    ).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    squares = dealt.select(
        "table", "key", "fp", "n", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select(
        "table", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp", "n"
    )
    where = ["table", "key", "low", "high"]
    met = squares.repartition(*where).sortWithinPartitions(*where).mapInArrow(
        _compared(radius, places, choices), "fp binary, n_near long"
    )
    sums = met.groupBy("fp").agg(F.sum("n_near").alias("n_near"))
    named = nodes.select("fp", F.col("n").alias("n_docs")).join(sums.select(F.lower(F.hex("fp")).alias("fp"), "n_near"), "fp", "left")
    return named.select(F.col("fp").alias("fingerprint"), "n_docs", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def _compared(radius: int, places: list[tuple[int, int]], choices: list[tuple[int, ...]]):
    """Rows sorted by list and square: for each row the documents of the rows it is near to."""
    chosen = np.array(choices)
    matching = chosen.shape[1]

    def equal_blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        digits = np.stack([(a ^ b) >> 4, (a ^ b) & 15], axis=2).reshape(len(a), -1)
        return np.stack([~digits[:, first:first + size].any(axis=1) for first, size in places], axis=1)

    def sums(table, list_, own, low, high, prints, n) -> np.ndarray:
        total, words = np.zeros(len(n), np.int64), prints.view(np.uint64).reshape(len(n), -1)
        at = np.arange(len(n))
        for gap in range(1, len(n)):
            at = at[at + gap < len(n)]
            at = at[list_[at] == list_[at + gap]]
            if not len(at):
                break
            other = at + gap
            fits = (low[at] == high[at]) | (own[at] != own[other])
            fits &= np.bitwise_count(words[at] ^ words[other]).sum(axis=1) <= radius
            a, b = at[fits], other[fits]
            if not len(a):
                continue
            # the first blocks in which they agree are the first table they meet in
            same = equal_blocks(prints[a], prints[b])
            first = np.argsort(~same, axis=1, kind="stable")[:, :matching]
            counts = (first == chosen[table[a]]).all(axis=1)
            np.add.at(total, a[counts], n[b[counts]])
            np.add.at(total, b[counts], n[a[counts]])
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def answered(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            numbers = [rows.column(i).to_numpy() for i in (0, 2, 3, 4, 6)]
            table, low, high, own, n = numbers
            keys = rows.column(1)
            changed = (table[1:] != table[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            changed |= pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy()
            list_ = np.concatenate([[0], np.cumsum(changed)])
            prints = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint8).reshape(len(n), -1)
            total = sums(table, list_, own, low, high, prints, n)
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [rows.column(5).take(pa.array(some)).combine_chunks().cast(pa.binary()), pa.array(total[some])],
                names=["fp", "n_near"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            # the last list may go on in the next batch
            last = [rows.column(i)[-1].as_py() for i in range(4)]
            split = rows.num_rows
            while split and [rows.column(i)[split - 1].as_py() for i in range(4)] == last:
                split -= 1
            if split:
                yield answered(rows.slice(0, split))
            rest = rows.slice(split)
        if rest is not None:
            yield answered(rest)

    return run
