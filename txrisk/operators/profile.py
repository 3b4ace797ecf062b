"""Data-quality figures of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions.bands import percent
from txrisk.operators.quantiles import exact_quantiles, quantile_columns
from txrisk.schema import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS

QUARTILES = {"0.25": "p25", "0.5": "p50", "0.75": "p75"}


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns)).alias("column_count"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row, one count per column; NaN is not NULL."""
    return df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and the difference, from one shuffle of the rows."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("_copies"))
        .agg(
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
            F.count("*").alias("distinct_rows"),
            F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """The rows without their copies; each task drops its own copies before the shuffle."""
    return df.distinct()


def summary(df: DataFrame) -> DataFrame:
    """Spark's own text summary: count, mean, stddev, min, quartiles, max."""
    return df.summary()


def summary_stats(
    df: DataFrame, columns: list[str] = NUMERIC_COLUMNS, exact: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """Typed summary, one row per numeric column.

    Quartiles are approximate, in the same single pass as everything else, or with
    ``exact`` by further passes."""
    measures = {
        "count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max,
    }
    if not exact:
        measures |= {
            name: (lambda c, p=float(p): F.percentile_approx(c, p, accuracy)) for p, name in QUARTILES.items()
        }
    # The moments of all columns come from one pass over the rows as they are;
    # only the quartiles need the columns below each other.
    wide = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{c}|{m}") for c in columns for m, f in measures.items()]
    )
    moments = wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), *[F.col(f"{c}|{m}").alias(m) for m in measures])
                    for c in columns
                ]
            )
        ).alias("row")
    ).select("row.*")
    if not exact:
        return moments.select("column", "count", "mean", "stddev", "min", *QUARTILES.values(), "max")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "v"
    )
    quartiles = quantile_columns(
        exact_quantiles(long, F.col("v"), list(QUARTILES), series=F.col("column")),
        QUARTILES,
        by_series=True,
    )
    joined = moments.join(
        F.broadcast(quartiles), F.col("column") == F.col("series"), "left"
    )
    return joined.select("column", "count", "mean", "stddev", "min", *QUARTILES.values(), "max")


def value_distribution(df: DataFrame, columns: list[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Count and share of each value of each column, all columns in one shuffle."""
    total = df.agg(F.count("*")).scalar()
    return (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column", "value")
        .groupBy("column", "value")
        .agg(F.count("*").alias("count"))
        .withColumn("percentage", percent(F.col("count"), total))
        .orderBy("column", F.desc("count"), "value")
    )


def fraud_rate(df: DataFrame) -> DataFrame:
    """Totals and the fraud rate in percent; NULL for an empty table."""
    fraud = F.count_if(F.col("is_fraud") == 1)
    total = F.count("*")
    return df.agg(
        total.alias("total_transactions"),
        fraud.alias("fraud_transactions"),
        (total - fraud).alias("legitimate_transactions"),
        percent(fraud, total, 4).alias("fraud_rate"),
    )


def duplicate_keys(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """How many key values occur more than once; NULL counts as a value."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("cnt"))
        .filter("cnt > 1")
        .agg(F.count("*").alias("duplicate_keys"))
    )


def sample_rows(df: DataFrame, n: int = 10, key: str = "transaction_id") -> DataFrame:
    """The first ``n`` rows by id."""
    return df.orderBy(key).limit(n)


