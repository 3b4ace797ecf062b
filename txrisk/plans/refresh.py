"""Keeping the scored table up when transactions arrive.

A transaction's behaviour columns depend on its user's rows only, its amount indicators on the statistics
of all amounts. So only users with new rows are scored from the transactions; all others keep their behaviour
columns. Their buckets are not touched at all when the statistics are the same as before, and otherwise
get their indicators, scores and levels anew in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.operators.amounts import amount_stats
from txrisk.plans.scoring import score_with, with_behaviour
from txrisk.schema import BEHAVIOUR_COLUMNS, TRANSACTION_COLUMNS
from txrisk.sources.staging import stage
from txrisk.sources.versions import bucket_of, publish, state_of
from txrisk.spec import RiskSpec, SkewPolicy

STATS = ["p95_amount", "avg_amount", "stddev_amount"]
BUCKETS = 64


def _facts(rows: DataFrame, spec: RiskSpec, exact: bool) -> dict:
    """The three statistics, in a form that keeps every digit; one row for the driver."""
    row = amount_stats(rows, exact=exact, spec=spec).select(*STATS).first()
    return {"exact": exact, "stats": {n: None if row[n] is None else float(row[n]).hex() for n in STATS}}


def _stats(facts: dict):
    values = {n: None if v is None else float.fromhex(v) for n, v in facts["stats"].items()}
    return F.struct(*[F.lit(values[n]).cast("double").alias(n) for n in STATS])


def publish_scored(
    tx: DataFrame,
    table: str,
    spec: RiskSpec = RiskSpec(),
    exact: bool = False,
    policy: SkewPolicy | None = SkewPolicy(),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Score all of ``tx`` (unique ids) as a new version of ``table``, bucketed by user."""
    facts = _facts(tx, spec, exact)
    publish(score_with(with_behaviour(tx, spec, policy), _stats(facts), spec), table, "user_id", buckets, facts)
    return tx.sparkSession.table(table)


def rescore(
    spark: SparkSession,
    table: str,
    new_rows: DataFrame,
    spec: RiskSpec = RiskSpec(),
    policy: SkewPolicy | None = SkewPolicy(),
) -> DataFrame:
    """Add ``new_rows`` (transactions with ids of their own) to a table of ``publish_scored``.

    The result is that of scoring all rows again. New rows of an id the table has are refused. Exact
    percentiles are compared with all amounts, one narrow column; approximate ones may differ in their error.
    """
    state = state_of(spark, table)
    if state is None:
        raise ValueError(f"{table} does not exist: see publish_scored")
    old = spark.table(table)
    new_rows = stage(new_rows.select(*TRANSACTION_COLUMNS), "arrived")
    if known := old.join(new_rows.select("transaction_id"), "transaction_id", "left_semi").first():
        raise ValueError(f"transaction {known['transaction_id']} is in {table} already")
    changed = stage(new_rows.select(F.col("user_id").alias("_user")).distinct(), "changed")
    same = F.col("user_id").eqNullSafe(F.col("_user"))
    facts = _facts(old.select(*TRANSACTION_COLUMNS).unionByName(new_rows), spec, state.facts["exact"])
    only = None
    if facts == state.facts:
        touched = changed.select(bucket_of("_user", state.buckets).alias("b")).distinct().collect()
        only = {r["b"] for r in touched}  # at most one row for each bucket
        old = old.filter(bucket_of("user_id", state.buckets).isin(only))
    again = old.join(changed, same, "left_semi").select(*TRANSACTION_COLUMNS).unionByName(new_rows)
    kept = old.join(changed, same, "left_anti").select(*TRANSACTION_COLUMNS, *BEHAVIOUR_COLUMNS)
    rows = with_behaviour(again, spec, policy).select(*TRANSACTION_COLUMNS, *BEHAVIOUR_COLUMNS).unionByName(kept)
    publish(score_with(rows, _stats(facts), spec), table, state.key, state.buckets, facts, only)
    return spark.table(table)
