"""Statistics of the amounts of the whole table, as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators.quantiles import exact_quantiles, quantile_columns
from txrisk.operators.rows import merge_rows
from txrisk.spec import RiskSpec


def amount_stats(
    df: DataFrame, accuracy: int = 10_000, exact: bool = False, spec: RiskSpec = RiskSpec()
) -> DataFrame:
    """``p90_amount, p95_amount, avg_amount, stddev_amount``.

    The percentiles are approximate with bounded memory, or exact on request.
    """
    moments = [F.avg("amount").alias("avg_amount"), F.stddev_samp("amount").alias("stddev_amount")]
    lower, upper = spec.amount_lower_percentile, spec.amount_percentile
    names = ("p90_amount", "p95_amount")
    if not exact:
        return df.agg(
            F.percentile_approx("amount", float(lower), accuracy).alias(names[0]),
            F.percentile_approx("amount", float(upper), accuracy).alias(names[1]),
            *moments,
        )

    quantiles = exact_quantiles(df, F.col("amount"), [lower, upper], accuracy=accuracy)
    return merge_rows(
        quantile_columns(quantiles, {lower: names[0], upper: names[1]}), df.agg(*moments)
    )
