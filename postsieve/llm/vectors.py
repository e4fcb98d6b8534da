"""Vectors in tasks: which take part, a fixed rotation, and chunks of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_ROTATIONS: dict[int, np.ndarray] = {}


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero and holds only finite components."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")),
    )
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same for each call."""
    if dims not in _ROTATIONS:
        normal = np.random.default_rng(dims).normal(size=(dims, dims))
        q, r = np.linalg.qr(normal)
        _ROTATIONS[dims] = q * np.sign(np.diag(r))
    return _ROTATIONS[dims]
