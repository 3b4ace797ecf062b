"""Splitting a frame into ordinary and hot keys.

A window puts all rows of a key into one task. That is the cheapest plan for
ordinary keys and impossible for a key with a third of all rows, so per-key
operators treat the two kinds of key apart and union the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.spec import SkewPolicy

HOT_KEY = "_hot_key"


def hot_keys(df: DataFrame, key: str, policy: SkewPolicy) -> DataFrame:
    """The hot keys of ``df``, at most ``policy.max_keys`` rows."""
    total = df.agg(F.count("*")).scalar()
    limit = F.greatest(F.lit(policy.min_rows), F.ceil(total / F.lit(policy.max_keys)))
    return (
        df.groupBy(F.col(key).alias(HOT_KEY))
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > limit)
        .select(HOT_KEY)
    )


def split_hot(df: DataFrame, key: str, policy: SkewPolicy) -> tuple[DataFrame, DataFrame]:
    """``(ordinary rows, rows of hot keys)``; a NULL key is a key like any other."""
    hot = F.broadcast(hot_keys(df, key, policy))
    same = F.expr(f"{key} <=> {HOT_KEY}")
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")
