"""Different plans, same results."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.frames import same_rows
from tests.plain import plain_behaviour, plain_score
from txrisk.operators.deviation import habits
from txrisk.operators.frequency import txn_frequency
from txrisk.operators.quantiles import exact_quantiles
from txrisk.operators.sequence import previous_row
from txrisk.operators.skew import hot_keys, split_hot
from txrisk.plans.scoring import score, with_behaviour
from txrisk.schema import INDICATOR_COLUMNS, SCORED_COLUMNS
from txrisk.spec import RiskSpec, SkewPolicy

# One user of four is hot at this limit on the smallest scale.
SOME_HOT = SkewPolicy(min_rows=250)
ALL_HOT = SkewPolicy(min_rows=0)


def test_some_users_are_hot(tx):
    n = hot_keys(tx, "user_id", SOME_HOT).count()
    assert 0 < n < tx.select("user_id").distinct().count()


@pytest.mark.parametrize("policy", [None, SkewPolicy(), SOME_HOT, ALL_HOT])
def test_behaviour_equals_the_long_form(tx, policy):
    assert same_rows(with_behaviour(tx, policy=policy), plain_behaviour(tx))


def test_score_equals_the_long_form(tx):
    assert same_rows(score(tx, policy=SOME_HOT), plain_score(tx).select(SCORED_COLUMNS))


def test_score_is_the_weighted_sum_of_flags(tx):
    scored = score(tx)
    points = sum((F.col(f"indicator_{n}") * w for n, w in RiskSpec().weights.items()), F.lit(0))
    flags_ok = F.lit(True)
    for c in INDICATOR_COLUMNS:
        flags_ok = flags_ok & F.col(c).isin(0, 1)
    assert scored.filter(~flags_ok | (F.least(points, F.lit(100)) != F.col("risk_score"))).count() == 0
    assert scored.count() == tx.count()


def test_order_of_input_rows_changes_nothing(tx):
    assert same_rows(score(tx, exact=True), score(tx.orderBy(F.rand(7)).repartition(5), exact=True))


@pytest.mark.parametrize("policy", [SOME_HOT, ALL_HOT])
def test_sequence_and_habits_do_not_depend_on_the_split(tx, policy):
    flags = {"country": "new_country", "device": "new_device"}
    assert same_rows(habits(tx, flags, policy), habits(tx, flags, None))
    assert same_rows(previous_row(tx, ["country"], policy), previous_row(tx, ["country"], None))
    assert same_rows(txn_frequency(tx, policy=policy), txn_frequency(tx, policy=None))


def test_split_loses_no_row_and_bounds_the_hot_keys(spark):
    keys = [None] * 40 + [1] * 50 + list(range(2, 30))
    df = spark.createDataFrame([(k,) for k in keys], "user_id bigint")
    ordinary, hot = split_hot(df, "user_id", SkewPolicy(min_rows=10, max_keys=100))
    assert (ordinary.count(), hot.count()) == (28, 90)
    # With room for three hot keys a key must have more than a third of the rows.
    assert hot_keys(df, "user_id", SkewPolicy(min_rows=0, max_keys=3)).collect() == [(1,)]


def _quantiles(spark, values, probabilities, **how):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = exact_quantiles(df, F.col("x"), probabilities, **how).collect()
    return {r["probability"]: r["value"] for r in found}


SAMPLES = {
    "normal": lambda r: r.normal(size=3000),
    "heavy tail": lambda r: r.pareto(0.3, size=3000),
    "few values": lambda r: r.integers(0, 4, size=3000),
    "one value": lambda r: np.full(50, 7.25),
    "one row": lambda r: np.array([3.0]),
    "two rows": lambda r: np.array([3.0, 4.0]),
    "mostly zero": lambda r: np.where(r.random(3000) < 0.9, 0.0, r.random(3000)),
    "infinite": lambda r: np.concatenate([r.normal(size=300), [np.inf] * 40, [-np.inf] * 40]),
}


@pytest.mark.parametrize("kind", SAMPLES)
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_against_brute_force(spark, kind, accuracy):
    values = np.sort(SAMPLES[kind](np.random.default_rng(5)))
    asked = ["0", "0.25", "0.9", "0.95", "1"]
    got = _quantiles(spark, values, asked, accuracy=accuracy)
    n = len(values)
    for p in asked:
        rank = max(1, math.ceil(Decimal(p) * n))
        assert got[p] == values[rank - 1], p


@pytest.mark.parametrize("kind", [k for k in SAMPLES if k != "infinite"])
def test_median_against_brute_force(spark, kind):
    values = SAMPLES[kind](np.random.default_rng(6))
    got = _quantiles(spark, values, ["0.5"], interpolate=True, accuracy=50)
    assert got["0.5"] == pytest.approx(float(np.median(values)), rel=1e-12)


def test_nan_is_the_largest_value(spark):
    got = _quantiles(spark, [1.0, 2.0, float("nan"), 3.0], ["0.75", "1"])
    assert got["0.75"] == 3.0 and got["1"] != got["1"]


def test_a_scored_table_can_be_used_inside_a_scalar_subquery(tx):
    scored = score(tx, exact=True)
    total = scored.agg(F.count("*")).scalar()
    got = scored.groupBy("risk_level").agg(F.count("*").alias("n")).select((F.col("n") / total).alias("r"))
    assert got.agg(F.sum("r")).first()[0] == pytest.approx(1.0)
