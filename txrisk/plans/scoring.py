"""From transactions to scored transactions.

Profiles and amount statistics cover the whole table, including rows later than
the scored one: this is a batch score over full history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.bands import band
from txrisk.functions.indicators import indicators, risk_score, stats_columns
from txrisk.operators.amounts import amount_stats
from txrisk.operators.behaviour import user_profile
from txrisk.operators.frequency import trailing_by_second, trailing_by_window
from txrisk.operators.skew import split_hot
from txrisk.schema import BEHAVIOUR_COLUMNS, SCORED_COLUMNS
from txrisk.spec import RiskSpec, SkewPolicy


def with_behaviour(
    df: DataFrame, spec: RiskSpec = RiskSpec(), policy: SkewPolicy | None = SkewPolicy()
) -> DataFrame:
    """``df`` with the six behaviour columns; they are NULL where an id is NULL.

    Ordinary users need one shuffle of the rows: the frequency windows, then the
    profile join on the same partitioning. Hot users are counted per second, and
    their profiles (one row per hot user, so bounded) are broadcast.
    """
    windows = spec.trailing_windows
    if policy is None:
        joined = trailing_by_window(df, windows).join(user_profile(df), "user_id", "left")
    else:
        ordinary, hot = split_hot(df, "user_id", policy)
        joined = (
            trailing_by_window(ordinary, windows)
            .join(user_profile(df), "user_id", "left")
            .unionByName(
                trailing_by_second(hot, windows).join(
                    F.broadcast(user_profile(hot)), "user_id", "left"
                )
            )
        )
    known = "user_id IS NOT NULL AND transaction_id IS NOT NULL"
    return joined.selectExpr(
        *df.columns, *[f"CASE WHEN {known} THEN {c} END AS {c}" for c in BEHAVIOUR_COLUMNS]
    )


def stats_struct(
    df: DataFrame, spec: RiskSpec = RiskSpec(), exact: bool = False, accuracy: int = 10_000
) -> Column:
    """The amount statistics the indicators need, as a one-row scalar subquery."""
    stats = amount_stats(df, accuracy=accuracy, exact=exact, spec=spec)
    return stats.select(F.struct("p95_amount", "avg_amount", "stddev_amount").alias("stats")).scalar()


def score(
    df: DataFrame,
    spec: RiskSpec = RiskSpec(),
    exact: bool = False,
    accuracy: int = 10_000,
    policy: SkewPolicy | None = SkewPolicy(),
) -> DataFrame:
    """The 29 columns of the scored table; expects unique transaction ids."""
    return score_with(with_behaviour(df, spec, policy), stats_struct(df, spec, exact, accuracy), spec)


def score_with(rows: DataFrame, stats: Column, spec: RiskSpec = RiskSpec()) -> DataFrame:
    """The same from rows that have their behaviour columns, by given amount statistics; no shuffle."""
    flags = [indicator.flag for indicator in indicators(spec)]
    return (
        rows.select("*", *stats_columns(stats))
        .selectExpr("*", *flags)
        .selectExpr("*", risk_score(spec))
        .withColumn("risk_level", band(F.col("risk_score"), spec.bands))
        .select(SCORED_COLUMNS)
    )
