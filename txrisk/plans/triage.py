"""The result queries over the scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.bands import band, level_rank, percent, ratio
from txrisk.schema import CASE_COLUMNS, TOP_RISK_COLUMNS
from txrisk.spec import TRIAGE_BANDS, Bands


def level_counts(scored: DataFrame) -> DataFrame:
    """One row: total and the rows per level."""
    level = F.col("risk_level")
    return scored.agg(
        F.count("*").alias("total_transactions"),
        F.count_if(level == "High").alias("high_risk"),
        F.count_if(level == "Medium").alias("medium_risk"),
        F.count_if(level == "Low").alias("low_risk"),
    )


def top_risk(scored: DataFrame, n: int = 20) -> DataFrame:
    return (
        scored.select(*TOP_RISK_COLUMNS)
        .orderBy(F.desc("risk_score"), "transaction_id")
        .limit(n)
    )


def top_cases(scored: DataFrame, n: int = 100, min_score: int = 70) -> DataFrame:
    """The worst ``n`` rows of at least ``min_score``; ties by amount, then id."""
    return (
        scored.filter(F.col("risk_score") >= min_score)
        .select(*CASE_COLUMNS)
        .orderBy(F.desc("risk_score"), F.desc("amount"), "transaction_id")
        .limit(n)
    )


def rows_of_level(scored: DataFrame, level: str = "High") -> DataFrame:
    """All rows of a level, worst first."""
    return scored.filter(F.col("risk_level") == level).orderBy(
        F.desc("risk_score"), "transaction_id"
    )


def score_histogram(scored: DataFrame) -> DataFrame:
    return (
        scored.groupBy("risk_score", "risk_level")
        .agg(F.count("*").alias("transaction_count"), F.sum("is_fraud").alias("actual_fraud_count"))
        .orderBy(F.desc("risk_score"), "risk_level")
    )


def fraud_rate_by_level(scored: DataFrame) -> DataFrame:
    fraud = F.sum("is_fraud")
    return (
        scored.groupBy("risk_level")
        .agg(
            F.count("*").alias("total_transactions"),
            fraud.alias("actual_fraud"),
            percent(fraud, F.count("*")).alias("fraud_rate_percent"),
        )
        .orderBy(level_rank(F.col("risk_level")), "risk_level")
    )


def _cuts(scored: DataFrame) -> DataFrame:
    """Fraud and other rows of each score and of all scores from it on; a row per score, 101 at most.
    Rows that are not known to be fraud or not are left out."""
    known = scored.filter(F.col("is_fraud").isNotNull())
    scores = known.groupBy("risk_score").agg(
        F.count_if(F.col("is_fraud") == 1).alias("fraud"), F.count_if(F.col("is_fraud") != 1).alias("other")
    )
    from_here, every = Window.orderBy(F.desc("risk_score")), Window.partitionBy()
    return scores.select(
        "risk_score", "fraud", "other",
        F.sum("fraud").over(from_here).alias("fraud_from"), F.sum("other").over(from_here).alias("other_from"),
        F.sum("fraud").over(every).alias("all_fraud"), F.sum("other").over(every).alias("all_other"),
    )


def threshold_table(scored: DataFrame) -> DataFrame:
    """What flagging all rows of at least a score would do, for every score: how many are flagged, how
    many of them are fraud, precision, recall and false-positive rate. The rows are read once."""
    flagged = F.col("fraud_from") + F.col("other_from")
    return (
        _cuts(scored)
        .select(
            "risk_score",
            flagged.alias("flagged"),
            F.col("fraud_from").alias("flagged_fraud"),
            ratio(F.col("fraud_from"), flagged).alias("precision"),
            ratio(F.col("fraud_from"), F.col("all_fraud")).alias("recall"),
            ratio(F.col("other_from"), F.col("all_other")).alias("false_positive_rate"),
        )
        .orderBy(F.desc("risk_score"))
    )


def score_auc(scored: DataFrame) -> DataFrame:
    """The chance that a fraud row scores higher than another one, equal scores counting half; one row,
    NULL without both kinds."""
    above = (F.col("fraud_from") - F.col("fraud")) + F.col("fraud") / 2
    return _cuts(scored).agg(
        F.coalesce(F.sum("fraud"), F.lit(0)).alias("fraud"),
        F.coalesce(F.sum("other"), F.lit(0)).alias("other"),
        ratio(F.sum(F.col("other") * above), F.sum("fraud").cast("double") * F.sum("other"), 6).alias("auc"),
    )


def kpis(scored: DataFrame, high_risk_score: int = 70) -> DataFrame:
    """The headline figures, one row; on an empty table only the count is set."""
    high = F.col("risk_score") >= high_risk_score
    risky = F.sum(F.when(high, 1).otherwise(0))
    return scored.agg(
        F.count("*").alias("total_transactions"),
        risky.alias("high_risk_transactions"),
        percent(risky, F.count("*")).alias("high_risk_percentage"),
        F.round(F.sum("amount"), 2).alias("total_transaction_amount"),
        F.round(F.sum(F.when(high, F.col("amount")).otherwise(0.0)), 2).alias("high_risk_amount"),
    )


def band_counts(scored: DataFrame, bands: Bands = TRIAGE_BANDS) -> DataFrame:
    return (
        scored.groupBy(band(F.col("risk_score"), bands).alias("risk_level"))
        .agg(F.count("*").alias("transaction_count"))
        .orderBy(F.desc("transaction_count"), "risk_level")
    )


def fraud_by(scored: DataFrame, column: str) -> DataFrame:
    """Fraud and all rows per value of ``column``, most fraud first."""
    return (
        scored.groupBy(column)
        .agg(F.sum("is_fraud").alias("fraud_transactions"), F.count("*").alias("total_transactions"))
        .orderBy(F.desc("fraud_transactions"), column)
    )
