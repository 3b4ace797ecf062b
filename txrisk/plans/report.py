"""Report rows: observed facts, assessment, and the ids they rest on.

Reports hold nothing but columns of the scored table and fixed rule texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.plans.investigate import customer_profile, top_risk_per_user
from txrisk.schema import INDICATORS, INDICATOR_COLUMNS
from txrisk.spec import INDICATOR_WEIGHTS

# The next step for each level.
NEXT_STEPS = {"High": "escalation", "Medium": "further review", "Low": "monitoring"}

OBSERVED_COLUMNS = [
    "user_id", "timestamp", "amount", "country", "device", "channel", "hour", "txn_count_1hr",
    "txn_count_24hr", "distinct_countries_user", "distinct_devices_user", "user_primary_country",
    "user_primary_device",
]


def next_step(level: Column) -> Column:
    step = F.lit(None).cast("string")
    for name, text in NEXT_STEPS.items():
        step = F.when(level == name, text).otherwise(step)
    return step


def fired_names() -> Column:
    return F.array_compact(
        F.array(*[F.when(F.col(c) == 1, n) for n, c in zip(INDICATORS, INDICATOR_COLUMNS)])
    )


def explanation_codes(weights: dict[str, int] = INDICATOR_WEIGHTS) -> Column:
    """``name+points`` of each indicator that fired."""
    return F.array_compact(
        F.array(
            *[F.when(F.col(f"indicator_{n}") == 1, f"{n}+{w}") for n, w in weights.items()]
        )
    )


def transaction_report(
    scored: DataFrame, weights: dict[str, int] = INDICATOR_WEIGHTS
) -> DataFrame:
    """One row per transaction; facts and conclusions in structs of their own."""
    return scored.select(
        "transaction_id",
        F.struct(*OBSERVED_COLUMNS).alias("observed"),
        F.struct(
            "risk_score",
            "risk_level",
            fired_names().alias("indicators"),
            explanation_codes(weights).alias("explanation"),
            next_step(F.col("risk_level")).alias("next_step"),
        ).alias("assessment"),
        F.array("transaction_id").alias("evidence"),
    )


def customer_report(scored: DataFrame, worst: int = 3, indicators: int = 3) -> DataFrame:
    """One row per user: profile, main indicators, and the worst transactions as
    evidence. Lists are bounded by ``worst`` and ``indicators``."""
    # Most frequent first; ties keep the order of the indicators.
    ranked = F.array_sort(
        F.array(
            *[
                F.struct((-F.col(c)).alias("k"), F.lit(i).alias("i"), F.lit(n).alias("name"))
                for i, (n, c) in enumerate(zip(INDICATORS, INDICATOR_COLUMNS))
            ]
        )
    )
    main = F.transform(
        F.slice(F.filter(ranked, lambda r: r["k"] < 0), 1, indicators), lambda r: r["name"]
    )
    cases = (
        top_risk_per_user(scored, worst)
        .groupBy("user_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", "transaction_id", "risk_score", "risk_level"))
            ).alias("cases")
        )
    )
    profile = customer_profile(scored, indicator_counts=True)
    facts = [c for c in profile.columns if c not in ("user_id", *INDICATOR_COLUMNS)]
    worst_level = (
        F.when(F.col("high_count") > 0, "High")
        .when(F.col("medium_count") > 0, "Medium")
        .otherwise("Low")
    )
    return profile.join(cases, "user_id").select(
        "user_id",
        F.struct(*facts).alias("observed"),
        F.struct(
            worst_level.alias("worst_level"),
            main.alias("main_indicators"),
            next_step(worst_level).alias("next_step"),
        ).alias("assessment"),
        F.transform("cases", lambda c: c["transaction_id"]).alias("evidence"),
    )
