"""Category choice by keyword counts, row by row: no shuffle, no explode.

A posting's words never leave its row. Keyword occurrences are filtered out of the token
array first; what is left is a handful of words, and all counting happens on those.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

_CATEGORIES_OF: dict[str, list[str]] = {}
for _category, _words in dims.CATEGORY_KEYWORDS.items():
    for _word in _words:
        _CATEGORIES_OF.setdefault(_word, []).append(_category)

_SINGLE = sorted(word for word in _CATEGORIES_OF if " " not in word)
_PAIRS = sorted(word for word in _CATEGORIES_OF if " " in word)
_PAIR_HEADS = sorted({pair.split()[0] for pair in _PAIRS})


def keyword_hits(tokens: Column) -> Column:
    """All occurrences of one- and two-word keywords in a token array."""
    single = F.filter(tokens, lambda word: word.isin(_SINGLE))
    pairs = F.filter(
        F.transform(
            tokens,
            lambda word, i: F.when(word.isin(_PAIR_HEADS), F.concat_ws(" ", word, F.get(tokens, i + 1))),
        ),
        lambda pair: pair.isin(_PAIRS),
    )
    return F.concat(single, pairs)


def hit_categories(hits: Column) -> Column:
    """The categories of all hits, repeats included."""
    lists = ", ".join(
        f"{dims.sql_literal(word)}, array({', '.join(map(dims.sql_literal, categories))})"
        for word, categories in _CATEGORIES_OF.items()
    )
    categories_of = F.expr(f"map({lists})")
    return F.flatten(F.transform(hits, lambda word: F.element_at(categories_of, word)))


def ranked_categories(categories: Column) -> Column:
    """Distinct categories, most hits first, ties by name."""
    counted = F.transform(
        F.array_distinct(categories),
        lambda category: F.struct(
            (-F.size(F.filter(categories, lambda other: other == category))).alias("order"),
            category.alias("category"),
        ),
    )
    return F.transform(F.sort_array(counted), lambda entry: entry["category"])


def category_at(ranked: Column, place: int) -> Column:
    """The category in one place of the ranking, or the general one."""
    return F.coalesce(F.get(ranked, F.lit(place)), F.lit(dims.DEFAULT_CATEGORY))
