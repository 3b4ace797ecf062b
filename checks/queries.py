"""Every operator as a query over the test tables.

``transactions`` are derived from ``events`` and ``nation``; ``postings`` are raw
text rows from ``lineitem`` with repeated ids, for typing and de-duplication.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.fixtures import transactions
from txrisk.operators import prepare, profile
from txrisk.operators.amounts import amount_stats
from txrisk.operators.behaviour import (
    distinct_values,
    primary_value,
    user_profile,
    value_frequency,
)
from txrisk.operators.frequency import txn_frequency
from txrisk.operators.robust import robust_anomalies
from txrisk.plans import investigate as inv
from txrisk.plans import links, patterns, report, states, triage
from txrisk.plans.scoring import score, stats_struct, with_behaviour
from txrisk.schema import BEHAVIOUR_COLUMNS, INDICATOR_COLUMNS, TRANSACTION_COLUMNS
from txrisk.sources.staging import stage
from txrisk.spec import SkewPolicy

#: Tables whose columns are searched for links.
LINKED_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
EVERY_KEY_HOT = SkewPolicy(min_rows=0)

POSTINGS_SQL = """
SELECT CAST(l_orderkey AS STRING) AS transaction_id,
       CAST(l_suppkey AS STRING) AS user_id,
       date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') AS timestamp,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS amount,
       l_returnflag AS country, l_linestatus AS device,
       CAST(l_linenumber AS STRING) AS channel,
       CAST(l_linenumber AS STRING) AS hour,
       l_returnflag AS dayofweek,
       CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END AS coupon_applied,
       CAST(CAST(l_quantity AS DECIMAL(10,1)) AS STRING) AS num_items,
       CASE WHEN l_discount > 0.05 THEN '1' WHEN l_discount > 0 THEN '0' END AS is_fraud
FROM {lineitem}
"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POSTINGS_SQL, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def typed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.cast_to_schema(postings(spark, sf_dir), lenient=True)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _table_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    tables = {
        "transactions": tx,
        "scored_transactions": scored(spark, sf_dir),
        "documents": spark.read.parquet(f"{sf_dir}/documents.parquet"),
        "labels": spark.read.parquet(f"{sf_dir}/labels.parquet"),
    }
    return inv.table_links(tables, ["transaction_id", "user_id", "doc_id"])


def _discovered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.discovered_links({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in LINKED_TABLES})


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    explained = inv.explain(scored(spark, sf_dir), stats_struct(tx, exact=True))
    return explained.select("transaction_id", "risk_score", "risk_level", F.inline("factors"))


def _flat_transaction_report(scored: DataFrame) -> DataFrame:
    return report.transaction_report(scored).select(
        "transaction_id", "observed.*", "assessment.risk_score", "assessment.risk_level",
        F.concat_ws(",", "assessment.indicators").alias("indicators"),
        F.concat_ws(",", "assessment.explanation").alias("explanation"),
        "assessment.next_step",
        F.concat_ws(",", F.col("evidence").cast("array<string>")).alias("evidence"),
    )


def _flat_customer_report(scored: DataFrame) -> DataFrame:
    return report.customer_report(scored).select(
        "user_id", "observed.*", "assessment.worst_level",
        F.concat_ws(",", "assessment.main_indicators").alias("main_indicators"),
        "assessment.next_step",
        F.concat_ws(",", F.col("evidence").cast("array<string>")).alias("evidence"),
    )


def _profile_from_states(scored: DataFrame) -> DataFrame:
    """Profiles from the states of each half of the month, merged; the later values are numbered later."""
    early = F.dayofmonth("timestamp") <= 15
    first, then = scored.filter(early), scored.filter(~early)
    numbers = states.number_values(first)
    before = states.monthly_states(first, numbers)
    numbers = states.number_values(then, numbers)
    merged = states.merge_states(before, states.monthly_states(then, numbers), numbers)
    return states.profiles(merged, numbers)


def _flat_groups(scored: DataFrame) -> DataFrame:
    """Groups of users that are seen on one device and channel on at least ten days."""
    found = patterns.recurring_groups(scored, 10, 4, "1 day", ("country", "device", "channel"))
    return found.withColumn("users", F.concat_ws(",", F.col("users").cast("array<string>")))


def _with_copies(typed: DataFrame) -> DataFrame:
    """The typed postings with an exact copy of those of many items."""
    times = F.when(F.col("num_items") > 25, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return typed.select("*", F.explode(times).alias("_copy")).drop("_copy")


FromRows = Callable[[DataFrame], DataFrame]
FromTables = Callable[[SparkSession, str], DataFrame]

# Queries over the transactions.
ON_TRANSACTIONS: dict[str, FromRows] = {
    "table_shape": profile.shape,
    "summary_stats": lambda tx: _rounded(profile.summary_stats(tx, exact=True), 6, "mean", "stddev"),
    "value_distribution": profile.value_distribution,
    "fraud_rate": profile.fraud_rate,
    "amount_stats": lambda tx: _rounded(
        amount_stats(tx, exact=True), 6, "avg_amount", "stddev_amount"
    ),
    "txn_frequency": lambda tx: txn_frequency(tx).select(
        "transaction_id", "user_id", "txn_count_1hr", "txn_count_24hr"
    ),
    "txn_frequency_hot_users": lambda tx: txn_frequency(tx, policy=EVERY_KEY_HOT).select(
        "transaction_id", "user_id", "txn_count_1hr", "txn_count_24hr"
    ),
    "distinct_countries": lambda tx: distinct_values(tx, "country", "distinct_countries_user"),
    "distinct_devices": lambda tx: distinct_values(tx, "device", "distinct_devices_user"),
    "primary_country": lambda tx: primary_value(tx, "country", "user_primary_country"),
    "primary_device": lambda tx: primary_value(tx, "device", "user_primary_device"),
    "country_frequency": lambda tx: value_frequency(tx, "country"),
    "device_frequency": lambda tx: value_frequency(tx, "device"),
    "user_profile": user_profile,
    "user_patterns": lambda tx: with_behaviour(tx).select(
        "transaction_id", "user_id", *BEHAVIOUR_COLUMNS
    ),
    "sample_rows": profile.sample_rows,
    "monthly_count": inv.monthly_count,
    "monthly_amount": inv.monthly_amount,
    "amount_distribution": lambda tx: _rounded(inv.amount_distribution(tx), 6, "avg_amount"),
    "amount_histogram": inv.amount_histogram,
    "txn_by_country": inv.counts_by,
    "behaviour_change": inv.behaviour_change,
    "behaviour_drift": patterns.behaviour_drift,
    "multi_country_users": lambda tx: inv.users_with_many(tx, "country"),
    "multi_device_users": lambda tx: inv.users_with_many(tx, "device"),
    "countries_of_users": lambda tx: inv.values_of_users(tx, "country"),
    "devices_of_users": lambda tx: inv.values_of_users(tx, "device"),
    "country_switch": inv.country_switch,
    "country_switch_hot_users": lambda tx: inv.country_switch(tx, policy=EVERY_KEY_HOT),
    "unusual_characteristics": inv.unusual_characteristics,
    "unusual_characteristics_hot_users": lambda tx: inv.unusual_characteristics(
        tx, policy=EVERY_KEY_HOT
    ),
    "robust_anomalies": lambda tx: _rounded(robust_anomalies(tx), 6, "median_amount", "mad_amount"),
    "robust_anomalies_hot_users": lambda tx: _rounded(
        robust_anomalies(tx, policy=EVERY_KEY_HOT), 6, "median_amount", "mad_amount"
    ),
    "amount_anomalies": lambda tx: inv.amount_anomalies(tx, stats_struct(tx, exact=True)),
}

# The score itself, computed from the transactions.
SCORING: dict[str, FromRows] = {
    "indicators": lambda tx: score(tx, exact=True).select("transaction_id", *INDICATOR_COLUMNS),
    "risk_scores": lambda tx: score(tx, exact=True).select(
        "transaction_id", "risk_score", "risk_level"
    ),
    "scored_transactions": lambda tx: score(tx, exact=True),
    "scored_transactions_hot_users": lambda tx: score(tx, exact=True, policy=EVERY_KEY_HOT),
}

# Queries over the stored scored table.
ON_SCORED: dict[str, FromRows] = {
    "level_counts": triage.level_counts,
    "top20_risk": triage.top_risk,
    "high_risk_rows": triage.rows_of_level,
    "score_histogram": triage.score_histogram,
    "fraud_rate_by_level": triage.fraud_rate_by_level,
    "kpis": triage.kpis,
    "triage_band_counts": triage.band_counts,
    "fraud_by_device": lambda s: triage.fraud_by(s, "device"),
    "fraud_by_country": lambda s: triage.fraud_by(s, "country"),
    "fraud_by_channel": lambda s: triage.fraud_by(s, "channel"),
    "top100_high_risk": triage.top_cases,
    "threshold_table": triage.threshold_table,
    "score_auc": triage.score_auc,
    "results_by_level": inv.results_by_level,
    "customer_profile": inv.customer_profile,
    "customer_timeline": inv.customer_timeline,
    "customer_timeline_hot_users": lambda s: inv.customer_timeline(s, policy=EVERY_KEY_HOT),
    "top_risk_per_user": inv.top_risk_per_user,
    "indicator_prevalence": inv.indicator_prevalence,
    "indicator_combinations": inv.indicator_combinations,
    "indicator_pairs": inv.indicator_pairs,
    "geo_anomalies": inv.geo_anomalies,
    "device_anomalies": inv.device_anomalies,
    "time_anomalies": inv.time_anomalies,
    "risk_comparison": inv.risk_comparison,
    "coordinated_activity": lambda s: inv.coordinated_activity(s, min_users=2),
    "customer_profile_from_states": _profile_from_states,
    "indicator_rules": patterns.indicator_rules,
    "recurring_groups": _flat_groups,
    "transaction_report": _flat_transaction_report,
    "customer_report": _flat_customer_report,
}

# Queries over the raw text postings, and over the typed ones.
ON_POSTINGS: dict[str, FromRows] = {
    "cast_to_schema": lambda raw: prepare.cast_to_schema(raw, lenient=True),
    "reject_counts": prepare.reject_counts,
}
ON_TYPED_POSTINGS: dict[str, FromRows] = {
    "null_counts": profile.null_counts,
    "duplicate_rows": lambda t: profile.duplicate_rows(
        t.select("user_id", "country", "device", "num_items", "is_fraud")
    ),
    "duplicate_whole_rows": lambda t: profile.duplicate_rows(_with_copies(t)),
    "distinct_rows": lambda t: profile.distinct_rows(_with_copies(t)),
    "duplicate_keys": profile.duplicate_keys,
    "dedup_by_id": lambda t: prepare.dedup_by_id(t).select(TRANSACTION_COLUMNS),
    "dedup_audit": prepare.dedup_audit,
}

# Queries over several tables.
ON_TABLES: dict[str, FromTables] = {
    "table_links": _table_links,
    "discovered_links": _discovered_links,
    "explain_transaction": _explained,
}


_stored: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = stage(rows(), name)
    return _stored[key]


def transactions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as the table that ``build_scored`` expects: a score reads them seven times, a column or
    two each time, and from the events each of those would parse and join every row again."""
    return _once(spark, sf_dir, "transactions", lambda: transactions(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table, written once per session and scale like any stored table."""
    return _once(spark, sf_dir, "scored", lambda: score(transactions_table(spark, sf_dir), exact=True))


def _in_utc(query: FromTables) -> FromTables:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def _on(source: FromTables, query: FromRows) -> FromTables:
    return lambda spark, sf_dir: query(source(spark, sf_dir))


def queries() -> dict[str, FromTables]:
    groups = [
        (transactions, ON_TRANSACTIONS),
        (transactions_table, SCORING),
        (scored, ON_SCORED),
        (postings, ON_POSTINGS),
        (typed_postings, ON_TYPED_POSTINGS),
    ]
    found = {name: _on(source, q) for source, group in groups for name, q in group.items()}
    from checks.stored import STORED

    found |= ON_TABLES | STORED
    return {name: _in_utc(query) for name, query in found.items()}
