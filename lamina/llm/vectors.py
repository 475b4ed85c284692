"""Parsing of vector columns in tasks, and a principal basis from a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a basis is fitted on, about.
BASIS_ROWS = 20_000


def usable(v: Column) -> Column:
    """Not null or empty, all components finite, not all zero; as a condition without nulls."""
    d = v.cast("array<double>")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(d, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one width as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def width(df: DataFrame, v: str) -> int:
    """The commonest width; rows of another width can't be compared with it."""
    row = df.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def basis(df: DataFrame, v: str, dims: int, rows: int = BASIS_ROWS) -> np.ndarray:
    """Leading principal directions of unit vectors, from a hash sample of about ``rows``."""
    n = df.count()
    part = df if n <= rows else df.where(F.pmod(F.xxhash64(v), F.lit(n)) < rows)
    x = matrix(part.select(F.col(v).cast("array<double>").alias("v")).toArrow()["v"])
    if not len(x):
        return np.zeros((1, 0))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    x = x - x.mean(0)
    _, _, vt = np.linalg.svd(x.T @ x)
    return vt[:dims].T.copy()
