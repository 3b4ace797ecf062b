"""NULLs, ties, duplicates, empty tables and band borders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.frames import by_id, frame, row
from txrisk.functions.bands import band
from txrisk.functions.indicators import risk_score
from txrisk.operators import prepare, profile
from txrisk.operators.amounts import amount_stats
from txrisk.operators.behaviour import user_profile, value_frequency
from txrisk.operators.frequency import txn_frequency
from txrisk.plans import investigate, report, triage
from txrisk.plans.scoring import score, stats_struct
from txrisk.schema import BEHAVIOUR_COLUMNS, INDICATOR_COLUMNS, TRANSACTIONS
from txrisk.spec import SCORING_BANDS, TRIAGE_BANDS, RiskSpec, SkewPolicy

POLICIES = [None, SkewPolicy(), SkewPolicy(min_rows=0)]
BEHAVIOUR_FLAGS = INDICATOR_COLUMNS[2:8]


def test_duplicate_id_keeps_the_first_and_reports_the_rest(spark):
    raw = frame(spark, row(1, when=5, amount=2.0), row(1, when=1, amount=3.0), row(2))
    kept, audit = prepare.prepare(raw)
    assert by_id(kept)[1]["amount"] == 3.0 and kept.count() == 2
    (removed,) = audit.collect()
    assert (removed["amount"], removed["removed_copies"], removed["is_conflict"]) == (2.0, 1, True)
    assert raw.count() == 3 and raw.schema == TRANSACTIONS


def test_exact_copies_are_no_conflict_and_order_of_rows_does_not_matter(spark):
    rows = [row(1, amount=3.0), row(1, amount=1.0), row(1, amount=1.0), row(1, amount=1.0)]
    for order in (rows, rows[::-1]):
        kept, audit = prepare.prepare(frame(spark, *order))
        assert [r["amount"] for r in kept.collect()] == [1.0]
        assert {(r["amount"], r["removed_copies"], r["is_conflict"]) for r in audit.collect()} == {
            (1.0, 2, False), (3.0, 1, True),
        }


def test_rows_without_id_are_kept_or_collapsed(spark):
    raw = frame(spark, row(None), row(None), row(3))
    assert prepare.dedup_by_id(raw).count() == 3
    assert prepare.dedup_by_id(raw, null_ids="collapse").count() == 2
    assert profile.duplicate_keys(raw).first()[0] == 1


@pytest.mark.parametrize("policy", POLICIES)
def test_missing_ids_have_no_behaviour(spark, policy):
    scored = score(
        frame(
            spark,
            *[row(i, user=None, when=i) for i in range(4)],
            *[row(None, user=7, when=i) for i in range(2)],
            row(9, user=7, when=3),
        ),
        policy=policy,
    )
    for r in scored.filter("user_id IS NULL OR transaction_id IS NULL").collect():
        assert [r[c] for c in BEHAVIOUR_COLUMNS] == [None] * 6
        assert [r[c] for c in BEHAVIOUR_FLAGS] == [0] * 6
    # Rows without an id still count for the others of their user.
    assert by_id(scored)[9]["txn_count_1hr"] == 2


@pytest.mark.parametrize("policy", POLICIES)
def test_frame_counts_whole_seconds_and_peers(spark, policy):
    counts = by_id(
        txn_frequency(frame(spark, row(1, when=0.2), row(2, when=0.9), row(3, when=3600.95)), policy=policy)
    )
    assert [counts[i]["txn_count_1hr"] for i in (1, 2, 3)] == [1, 1, 2]


@pytest.mark.parametrize("policy", POLICIES)
def test_frame_ends(spark, policy):
    rows = [row(1, when=0), row(2, when=3600), row(3, when=3601), row(4, when=86400), row(5, when=86401)]
    counts = by_id(txn_frequency(frame(spark, *rows), policy=policy))
    assert [counts[i]["txn_count_1hr"] for i in range(1, 6)] == [0, 1, 1, 0, 1]
    assert [counts[i]["txn_count_24hr"] for i in range(1, 6)] == [0, 1, 2, 3, 3]


@pytest.mark.parametrize("policy", POLICIES)
def test_rows_without_time_are_peers_of_each_other_only(spark, policy):
    rows = [row(1, when=None), row(2, when=None), row(3, when=0), row(4, user=2, when=None)]
    counts = by_id(txn_frequency(frame(spark, *rows), policy=policy))
    assert [counts[i]["txn_count_1hr"] for i in range(1, 5)] == [1, 1, 0, 0]


@pytest.mark.parametrize("policy", POLICIES)
def test_times_before_1970_and_across_weeks(spark, policy):
    week = 7 * 86400
    rows = [row(i, when=-60 * 366 * 86400 + i * 1800) for i in range(4)]
    rows += [row(10 + i, when=week * 3 - 900 + i * 600) for i in range(4)]
    counts = by_id(txn_frequency(frame(spark, *rows), policy=policy))
    assert [counts[i]["txn_count_1hr"] for i in range(4)] == [0, 1, 2, 2]
    assert [counts[10 + i]["txn_count_1hr"] for i in range(4)] == [0, 1, 2, 3]


def test_primary_value_ties(spark):
    rows = [
        row(1, user=1, country="B"), row(2, user=1, country="A"),
        row(3, user=2, country=None), row(4, user=2, country="A"),
    ]
    df = frame(spark, *rows)
    primary = {r["user_id"]: r for r in user_profile(df).collect()}
    assert primary[1]["user_primary_country"] == "A"
    assert primary[2]["user_primary_country"] is None
    assert primary[2]["distinct_countries_user"] == 1
    flags = by_id(score(df))
    assert [flags[i]["indicator_unusual_country"] for i in range(1, 5)] == [1, 0, 0, 0]


def test_bands_at_their_borders(spark):
    scores = spark.createDataFrame([(s,) for s in (30, 32, 38, 40, 68, 70, 72)], "s int")
    got = scores.select(
        band(F.col("s"), SCORING_BANDS), band(F.col("s"), TRIAGE_BANDS)
    ).collect()
    assert [r[0] for r in got] == ["Low"] + ["Medium"] * 5 + ["High"]
    assert [r[1] for r in got] == ["Low Risk"] * 3 + ["Medium Risk"] * 2 + ["High Risk"] * 2


def test_score_is_capped(spark):
    all_on = spark.createDataFrame([(1,) * 9], INDICATOR_COLUMNS)
    assert sum(RiskSpec().weights.values()) == 110
    assert all_on.selectExpr(risk_score(RiskSpec())).first()[0] == 100


@pytest.mark.parametrize("exact", [False, True])
def test_one_row(spark, exact):
    one = frame(spark, row(1))
    assert amount_stats(one, exact=exact).first()["stddev_amount"] is None
    (scored,) = score(one, exact=exact).collect()
    assert scored["indicator_extreme_amount"] == 0 and scored["risk_level"] == "Low"


@pytest.mark.parametrize("exact", [False, True])
def test_empty_table(spark, exact):
    scored = score(frame(spark), exact=exact)
    assert scored.count() == 0
    assert list(triage.kpis(scored).first()) == [0, None, None, None, None]
    assert profile.fraud_rate(scored).first()["fraud_rate"] is None
    assert list(profile.duplicate_rows(frame(spark)).first()) == [0, 0, 0]
    assert amount_stats(frame(spark), exact=exact).first()["p95_amount"] is None
    assert triage.level_counts(scored).first()["total_transactions"] == 0


def test_nan_amount(spark):
    raw = frame(spark, row(1, amount=float("nan")), row(2, amount=1.0))
    assert profile.null_counts(raw).first()["amount"] == 0
    cleaned, _ = prepare.prepare(raw, nan_to_null=True)
    assert profile.null_counts(cleaned).first()["amount"] == 1
    assert by_id(score(raw))[1]["indicator_extreme_amount"] == 0


def test_unusual_hour(spark):
    hours = by_id(score(frame(spark, *[row(h, hour=h) for h in (1, 2, 4, 5)])))
    assert [hours[h]["indicator_unusual_hour"] for h in (1, 2, 4, 5)] == [0, 1, 1, 0]


def test_null_is_a_frequency_group(spark):
    df = frame(spark, row(1, country="US"), row(2, country="US"), row(3, country=None))
    counts = {r["country"]: r["country_count"] for r in value_frequency(df, "country").collect()}
    assert counts == {"US": 2, None: 1}
    assert user_profile(df).first()["distinct_countries_user"] == 1


@pytest.mark.parametrize("policy", POLICIES)
def test_previous_row_with_ties_and_missing_times(spark, policy):
    week = 7 * 86400
    rows = [
        row(5, when=None), row(4, when=None, country="B"), row(9, when=0.7), row(2, when=0.7),
        row(3, when=0.1), row(8, when=3 * week, country="C"), row(1, user=2, when=5), row(7, user=None),
    ]
    scored = score(frame(spark, *rows), policy=policy)
    timeline = by_id(investigate.customer_timeline(scored, policy=policy))
    assert sorted(timeline) == [1, 2, 3, 4, 5, 8, 9]
    assert [timeline[i]["gap_seconds"] for i in (3, 2, 9, 8, 1)] == [None, 0, 0, 3 * week, None]
    switches = investigate.country_switch(frame(spark, *rows), within=4 * week, policy=policy)
    assert [(r["transaction_id"], r["previous_country"]) for r in switches.collect()] == [(8, "A")]


def test_timeline_of_named_users_is_sorted(spark):
    scored = score(frame(spark, row(1, user=2, when=9), row(2, user=1, when=5), row(3, user=2, when=1)))
    ids = [r["transaction_id"] for r in investigate.customer_timeline(scored, users=[2]).collect()]
    assert ids == [3, 1]


def test_report_keeps_facts_and_conclusions_apart(spark):
    df = frame(spark, *[row(i, when=i, hour=3) for i in range(5)])
    scored = score(df)
    rep = by_id(report.transaction_report(scored))[4]
    assert rep["observed"]["txn_count_1hr"] == 4
    assert rep["assessment"]["indicators"] == ["high_frequency_1hr", "unusual_hour"]
    assert rep["assessment"]["explanation"] == ["high_frequency_1hr+20", "unusual_hour+5"]
    assert rep["assessment"]["next_step"] == "monitoring" and rep["evidence"] == [4]
    (customer,) = report.customer_report(scored, worst=2).collect()
    assert customer["evidence"] == [3, 4]
    assert customer["assessment"]["main_indicators"] == ["unusual_hour", "high_frequency_1hr"]
    factors = by_id(investigate.explain(scored, stats_struct(df)))[4]["factors"]
    assert sum(f["weight"] for f in factors) == 25
    assert factors[0].asDict() == {
        "indicator": "high_frequency_1hr", "weight": 20, "observed": "4", "threshold": "3",
    }


def test_table_links_need_a_shared_key(spark):
    with pytest.raises(ValueError):
        investigate.table_links({"a": frame(spark)}, ["user_id"])
