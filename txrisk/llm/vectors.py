"""Columns of vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries beyond this, after scaling, are refused: sums of squares would leave exact whole numbers.
LARGEST = 1 << 40


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    entry = F.col(vector).cast("array<double>")
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(entry.isNotNull() & ~bad, F.lit(False))


def scaled(rows: DataFrame, vector: str, factor: int, offset: int = 0) -> Column:
    """``floor(factor * entry) + offset`` of each entry, taken as a double."""
    return F.transform(
        F.col(vector).cast("array<double>"), lambda c: (F.floor(c * F.lit(float(factor))) + F.lit(offset)).cast("long")
    )


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The lists of whole numbers in a batch as the rows of a matrix; all must have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = len(column)
    width = (len(flat) // rows if rows else 0) if width is None else width
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    if (lengths != width).any():
        raise ValueError(f"vectors of {sorted({*lengths.tolist(), width})} entries in one column")
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError("an entry is too large to be counted in whole numbers")
    return flat.astype(np.int64).reshape(rows, width)
