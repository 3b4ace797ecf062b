"""Small helpers for one-row results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_rows(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns, side by side in one row."""
    columns = [c for frame in frames for c in frame.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in columns])
