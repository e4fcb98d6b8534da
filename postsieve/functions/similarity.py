"""Cosine scores (times 100) of a posting against one profile, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_score(vector: Column, profile: Column) -> Column:
    """Cosine of two numeric arrays; null if either has no length or the lengths differ."""
    dot = _total(F.zip_with(vector, profile, lambda x, y: x.cast("double") * y.cast("double")))
    return F.try_divide(dot * 100.0, _length(vector) * _length(profile))


def term_counts(ordered: Column) -> Column:
    """Entries (word, n) of a sorted token array, by word.

    Equal words stand together, so the places where the word changes give the run lengths.
    `ordered` is read several times and must be a column of its own.
    """
    starts = F.transform(ordered, lambda word, i: F.when(~word.eqNullSafe(F.get(ordered, i - 1)), i))
    ends = F.transform(ordered, lambda word, i: F.when(~word.eqNullSafe(F.get(ordered, i + 1)), i + 1))
    counts = F.zip_with(F.array_compact(starts), F.array_compact(ends), lambda start, end: (end - start).cast("double"))
    return F.zip_with(
        F.array_distinct(ordered), counts, lambda word, n: F.struct(word.alias("word"), n.alias("n"))
    )


def squared_length(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda total, entry: total + entry["n"] * entry["n"])


def merged(entries: Column, others: Column) -> Column:
    """Two arrays of entries in one order. Both are sorted, so the sort finds two runs and merges them in linear time."""
    return F.sort_array(F.concat(entries, others))


def merged_product(entries: Column) -> Column:
    """Dot product of two arrays of entries that have been merged: a word that both hold stands there twice.

    Linear in their lengths. `entries` is read several times and must be a column of its own.
    """
    products = F.transform(
        entries,
        lambda entry, i: F.when(F.get(entries, i + 1)["word"] == entry["word"], entry["n"] * F.get(entries, i + 1)["n"]),
    )
    return F.aggregate(products, F.lit(0.0), lambda total, product: total + F.coalesce(product, F.lit(0.0)))


def _length(vector: Column) -> Column:
    return F.sqrt(_total(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x)
