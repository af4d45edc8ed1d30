"""Vectors of a DataFrame as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Whether a vector takes part: neither null nor zero, and without null or non-finite components."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def finite(column: str) -> Column:
    """Whether a vector is there and holds neither null nor non-finite components."""
    x = F.col(column)
    return F.coalesce(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def raw_matrix(column: pa.Array) -> np.ndarray:
    """An array of equally long lists as a matrix of the type it has."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def matrix(column: pa.Array) -> np.ndarray:
    """An array of equally long lists as a matrix of doubles."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def salted(df: DataFrame, key: str, count: int, seed: int) -> Column:
    """A seeded hash of ``key`` dealt to 0..count-1."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(count)).cast("int")
