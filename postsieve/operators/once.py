"""Evaluating an expensive expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    The optimizer moves a filter below the projection it reads from and puts the projected
    expression into the condition, once for every mention. For a JSON parse or a page clean-up
    that multiplies the cost of the whole scan. A generator of one row is a step filters do not
    move through. All columns named are computed, needed later or not, so name only needed ones.
    """
    entry = F.struct(*(column.alias(name) for name, column in columns.items()))
    return df.select("*", F.inline(F.array(entry)))
