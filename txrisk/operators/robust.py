"""How far an amount is from its user's median, in median absolute deviations.

Unlike mean and standard deviation, neither is moved by the few amounts that are looked for. Both are exact.
Ordinary users' medians come from their rows, counted per value before the shuffle; those of hot users from
slices of which only the one with the rank is sorted, so no task holds a hot user's amounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.operators.quantiles import exact_quantiles
from txrisk.operators.skew import split_hot
from txrisk.spec import SkewPolicy

#: Makes the deviation of a normal distribution its standard deviation: a fixed value.
NORMAL = 1.4826


def _medians(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(F.col("user_id").alias("_user")).agg(F.percentile(value, 0.5).alias(name))


def _hot_medians(df: DataFrame, value: Column, name: str) -> DataFrame:
    found = exact_quantiles(df, value, ["0.5"], series=F.col("user_id"), interpolate=True)
    return found.select(F.col("series").alias("_user"), F.col("value").alias(name))


def _with(df: DataFrame, medians: DataFrame) -> DataFrame:
    return df.join(medians, F.col("user_id") == F.col("_user"), "left").drop("_user")


def robust_deviation(df: DataFrame, policy: SkewPolicy | None = SkewPolicy()) -> DataFrame:
    """``df`` with the user's ``median_amount``, its median absolute deviation ``mad_amount``, and
    ``robust_z``, NULL where the deviation is zero or NULL. Rows without a user are left out.

    The medians of hot users are one row for each, as many as the policy allows, and are broadcast.
    """
    known = df.filter(F.col("user_id").isNotNull())
    amount, away = F.col("amount"), F.abs(F.col("amount") - F.col("median_amount"))

    def placed(rows: DataFrame, medians, near) -> DataFrame:
        rows = _with(rows, near(medians(rows, amount, "median_amount")))
        return _with(rows, near(medians(rows, away, "mad_amount")))

    if policy is None:
        found = placed(known, _medians, lambda x: x)
    else:
        ordinary, hot = split_hot(known, "user_id", policy)
        found = placed(ordinary, _medians, lambda x: x).unionByName(placed(hot, _hot_medians, F.broadcast))
    distance = F.try_divide(amount - F.col("median_amount"), F.lit(NORMAL) * F.col("mad_amount"))
    return found.withColumn("robust_z", F.round(distance, 4))


def robust_anomalies(
    df: DataFrame, threshold: float = 3.5, policy: SkewPolicy | None = SkewPolicy()
) -> DataFrame:
    """Rows whose amount is at least ``threshold`` robust deviations away from the user's median."""
    rows = robust_deviation(df.select("transaction_id", "user_id", "amount"), policy)
    return rows.filter(F.abs("robust_z") >= threshold)
