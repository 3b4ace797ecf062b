"""Per-user countries and devices: frequencies, distinct counts, primary value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_frequency(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rows per user and value; NULL is a value of its own."""
    return df.groupBy("user_id", column).agg(F.count("*").alias(name or f"{column}_count"))


def distinct_values(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct non-NULL values per user."""
    return df.groupBy("user_id").agg(F.count_distinct(column).alias(name))


def primary_value(df: DataFrame, column: str, name: str) -> DataFrame:
    """Each user's most frequent value; ties go to the smallest, NULL first."""
    best = F.min(F.struct((-F.col("_n")).alias("rank"), F.col(column).alias("value")))
    return (
        value_frequency(df, column, "_n")
        .groupBy("user_id")
        .agg(best["value"].alias(name))
    )


def user_profile(df: DataFrame) -> DataFrame:
    """Distinct and primary country and device, one row per user, in one scan.

    Rows shrink to user x country x device counts before the first shuffle; the
    country and device legs are cut from those counts instead of the rows.
    """
    combos = df.groupBy("user_id", "country", "device").agg(F.count("*").alias("n"))
    legs = (
        combos.selectExpr(
            "user_id", "n", "stack(2, true, country, false, device) AS (is_country, value)"
        )
        .groupBy("user_id", "is_country", "value")
        .agg(F.sum("n").alias("n"))
    )
    best = "min(CASE WHEN {0} THEN named_struct('rank', -n, 'value', value) END).value"
    return legs.groupBy("user_id").agg(
        F.expr("count(CASE WHEN is_country THEN value END) AS distinct_countries_user"),
        F.expr("count(CASE WHEN NOT is_country THEN value END) AS distinct_devices_user"),
        F.expr(f"{best.format('is_country')} AS user_primary_country"),
        F.expr(f"{best.format('NOT is_country')} AS user_primary_device"),
    )
