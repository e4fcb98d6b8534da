"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every byte of a text starts a suffix, of which only the first `LENGTH` bytes count. Suffixes are dealt
out by one digit after another; a suffix that is alone in its group is done, and so is one whose
group can hold only equal strings. What is left together after all bytes are the repeats.

The digits are chosen so that few suffixes have to move:

1. The first digit of a suffix is the `KEY` bytes with the least hash within its first LENGTH
   bytes. Neighbouring suffixes share that place, so one row (a cell) stands for about a hundred of them.
   Equal strings have equal digits at equal distances.
2. Cells that share the first digit are dealt by all bytes that their suffixes cover. Equal cells
   are repeats as a whole; one of each group stays, for the cells that differ from it.
3. Only in groups with cells that differ do suffixes get rows of their own, dealt by a hash of 96
   bits over their LENGTH bytes. Those that stay alone are kept.

Digits of steps 1 and 2 are hashes of 64 bits: a collision there costs rows, never a result, as
equal cells are compared within one first digit. All groups are counted with sums and minima that
are combined before the shuffle; rows return to their text only where a group has two.

Repeated strings of words go through the same passes in the same rows: a text is then the sequence of
its words' hashes, so that blanks do not count, and a place holds the start, the kind (1 for words) and how many
suffixes more its cell has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm import hashing
from postsieve.llm.base import settle

#: Bytes of a repeated string, and of the first digit.
LENGTH = 400
KEY = 200
#: Words of a repeated passage (over 50 of them), and of its first digit.
WORDS = 51
WORD_KEY = 20
_PLACE = np.uint64((1 << 31) - 1)
_WORD_COLUMN = ["n_repeated_words"]
#: Bits in which a place holds the number of its cell's further suffixes, at most `length` - `key`.
_MANY = 20


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    return np.minimum(values[:len(values) - (width - k)], values[width - k:])


def _numbers(text: bytes, kind: int) -> np.ndarray:
    """A number for each byte (kind 0) or word (kind 1)."""
    return hashing.word_hashes(text) if kind else hashing.BYTE[np.frombuffer(text, np.uint8)]


def cells(numbers: np.ndarray, length: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a text's suffixes: (first digit, whole content, first start, last start) of each cell, or None."""
    n = len(numbers) - length + 1
    if n <= 0:
        return None
    sums = hashing.number_sums(numbers)
    digit = hashing.windows(sums, key)
    least = _sliding_min((digit & ~_PLACE) | np.arange(len(digit), dtype=np.uint64), length - key + 1) & _PLACE
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.concatenate((first[1:], [n])) - 1
    return digit[least[first].astype(np.int64)], hashing.ranges(sums, first, last + length), first, last


def _cell_rows(sizes: list[tuple[int, int]]):
    """Rows (digit, whole, doc, place) of all cells; doc is the row's hash; `sizes` has (length, key) of each kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digit", "whole", "doc", "place"]
        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for kind, (length, key) in enumerate(sizes if text.is_valid else []):
                    own = cells(_numbers(text.as_buffer(), kind), length, key)
                    if own is not None:
                        places = (own[2] * 2 + kind) << _MANY | own[3] - own[2]
                        held.append((own[0].view(np.int64), own[1].view(np.int64), np.full(len(own[0]), doc), places))
                        size += len(own[0])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for their one shuffle."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [squeeze.compress(t.as_buffer()) if t.is_valid else None for t in batch.column(2)]
        body = pa.StructArray.from_arrays([batch.column(1), pa.array(texts, pa.binary())], names=["id", "text"])
        yield pa.RecordBatch.from_arrays([batch.column(0), body], names=["doc", "body"])


def _starts(places: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in the cells at `places`."""
    first, many = places >> _MANY + 1, (places & (1 << _MANY) - 1) + 1
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _of_kind(entries: np.ndarray, kind: int) -> np.ndarray:
    return entries[(entries >> _MANY + 2 & 1) == kind]


def _suffix_rows(lengths: list[int]):
    """Rows (high, low, weight, doc, place) of the suffixes in cells that differ from others of their digit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, packed, listed in zip(batch.column(0), batch.column(1).field("text"), batch.column(2)):
                text = expand.decompress(packed.as_buffer())
                entries = np.asarray(listed.values)
                for kind, length in enumerate(lengths):
                    mine = _of_kind(entries, kind)
                    if not (mine & 3).any():
                        continue
                    numbers = _numbers(text, kind)
                    sums = [hashing.number_sums(numbers, base) for base in hashing.BASES]
                    for weight in (1, 2):
                        at = _starts(np.unique(mine[(mine & weight) > 0] >> 2))
                        if not len(at):
                            continue
                        high, low = (hashing.ranges(s, at, at + length, base) for s, base in zip(sums, hashing.BASES))
                        n = len(at)
                        for i in range(0, n, 100_000):
                            part = slice(i, i + 100_000)
                            m = len(at[part])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(high[part].view(np.int64)), pa.array((low[part] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                                 pa.array(np.full(m, weight)), pa.array(np.full(m, doc.as_py())), pa.array(at[part] * 2 + kind)],
                                names=["high", "low", "weight", "doc", "place"],
                            )
    return run


def _covered(n: int, length: int, entries: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Of each of `n` bytes or words: whether a repeated string covers it; `entries` and `alone` are those of its kind."""
    # every repeated cell has an entry with flag 0; those with flag 1 lose the suffixes that are alone
    hit = np.zeros(n, bool)
    hit[_starts(entries[(entries & 3) == 0] >> 2)] = True
    hit[alone >> 1] = False
    starts = np.flatnonzero(hit)
    gone = np.zeros(n + 1, np.int64)
    gone[starts] = 1
    gone[starts + length] -= 1
    return np.cumsum(gone[:-1]) > 0


def _cut(lengths: list[int], keep_text: bool):
    """The result row of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        none = np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            body = batch.column(0)
            for ident, packed, listed, alone in zip(body.field("id"), body.field("text"), batch.column(1), batch.column(2)):
                text = expand.decompress(packed.as_buffer()) if packed.is_valid else b""
                entries = np.asarray(listed.values) if listed.is_valid else none
                places = np.asarray(alone.values) if alone.is_valid else none
                covered = []
                for kind, length in enumerate(lengths):
                    mine = _of_kind(entries, kind)
                    # words count only up to the last listed string
                    n = len(text) if not kind else int(_starts(mine >> 2)[-1]) + length if len(mine) else 0
                    covered.append(_covered(n, length, mine, places[(places & 1) == kind]))
                removed = covered[0]
                edges = np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))
                left = np.frombuffer(text, np.uint8)[~removed].tobytes()
                row = (ident.as_py(), len(text), int(removed.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest())
                row += ((left if packed.is_valid else None),) if keep_text else ()
                rows.append(row + tuple(int(c.sum()) for c in covered[1:]))
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text + _WORD_COLUMN[:len(lengths) - 1]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep_text + [pa.int64()] * (len(lengths) - 1)
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
    return run


def remove_repeats(
    docs: DataFrame, *, ident: str = "doc_id", text: str = "text", length: int = LENGTH, key: int = KEY,
    keep_text: bool = False, words: int = 0, word_key: int = WORD_KEY,
) -> DataFrame:
    """One row per document: `ident`, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the bytes left).

    With `words`, also n_repeated_words: the words that a string of as many words covers which starts
    anywhere else too, whatever its bytes and the blanks between. They are counted, not removed.

    Every byte is removed that a string of `length` bytes covers which starts anywhere else too, in
    the same text or another. Strings may overlap, never cross texts, and are judged on the input.
    A null text counts as empty (kept is null); texts below `length` bytes stay whole; equal rows are
    repeats of each other and lose all; ids are not looked at and may be null or repeat; an empty
    table gives an empty result; other columns are not read. `length` must exceed `key`, and `words` `word_key`.
    """
    if max(length - key, words - word_key) >> _MANY:
        raise ValueError(f"length - key must be below {1 << _MANY}")
    sizes = [(length, key)] + [(words, word_key)] * (words > 0)
    body = docs.select(
        F.xxhash64(F.col(ident), F.col(text)).alias("doc"), F.col(ident).cast("long").alias("id"),
        F.col(text).cast("binary").alias("text"),
    )
    rows = body.select("doc", "text").mapInArrow(_cell_rows(sizes), "digit long, whole long, doc long, place long")
    # written, so that the join has a plain shuffle on both sides and a digit with many cells can be split
    shared = settle(rows.select("digit").groupBy("digit").count().where("count > 1").select("digit"), "suffix_digits")
    found = settle(rows.join(shared, "digit"), "suffix_cells")
    equal = found.groupBy("digit", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("one"))
    equal = settle(equal, "suffix_equal")
    several = equal.groupBy("digit").count().where("count > 1").select("digit")
    opened = equal.join(several, "digit").select(
        "one.doc", (F.col("one.place") * 4 + F.when(F.col("n") == 1, 1).otherwise(2)).alias("entry")
    )
    lists = settle(
        found.select("doc", (F.col("place") * 4).alias("entry")).unionAll(opened)
        .groupBy("doc").agg(F.sort_array(F.collect_list("entry")).alias("entries")),
        "suffix_lists",
    )
    # both uses below take the same columns, so that texts are shuffled once
    texts = body.mapInArrow(_packed, "doc long not null, body struct<id: long, text: binary>").repartition("doc")
    listed = texts.join(lists, "doc", "left")
    single = (
        listed.where(F.exists("entries", lambda e: e % 4 > 0)).select("doc", "body", "entries")
        .mapInArrow(_suffix_rows([n for n, _ in sizes]), "high long, low int, weight long, doc long, place long")
        .groupBy("high", "low").agg(F.sum("weight").alias("n"), F.min("doc").alias("doc"), F.min("place").alias("place"))
        .where("n = 1").groupBy("doc").agg(F.collect_list("place").alias("alone"))
    )
    more = (", kept binary" if keep_text else "") + (", n_repeated_words long" if words else "")
    done = listed.join(single, "doc", "left").select("body", "entries", "alone").mapInArrow(
        _cut([n for n, _ in sizes], keep_text), f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}"
    )
    return done.withColumnRenamed("id", ident)
