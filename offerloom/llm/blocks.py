"""Vectors packed into blocks: one row of bytes for many vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = "ids binary, weights binary, vectors binary"


def usable(vector: Column, allow_zero: bool) -> Column:
    """Whether all components are finite numbers (and, unless allowed, not all zero)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))
    if allow_zero:
        return good
    return good & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def dimension(vectors: DataFrame, column: str) -> int:
    """The longest vector; shorter ones are read as padded with zeros."""
    return vectors.agg(F.max(F.size(column))).first()[0] or 0


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of doubles, padded with zeros."""
    if len(vectors) and all(len(v) == width for v in vectors):
        return np.array(vectors.tolist(), np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def unpacked(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, width)
