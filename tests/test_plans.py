"""The shape of the physical plans."""

from __future__ import annotations

import pytest

from txrisk.operators import prepare
from txrisk.operators.behaviour import user_profile
from txrisk.operators.frequency import trailing_by_window
from txrisk.plans import investigate, triage
from txrisk.plans.scoring import score
from txrisk.sources.staging import stage
from txrisk.spec import RiskSpec, SkewPolicy


@pytest.fixture
def no_broadcast(spark):
    """Plans as for large tables: nothing is small enough to broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df) -> list[str]:
    """Lines of the plan adaptive execution ended with."""
    df.collect()
    return planned(df).split("\n+- == Initial Plan ==")[0].splitlines()


def test_two_frames_share_one_exchange_and_sort(tx):
    plan = planned(trailing_by_window(tx, RiskSpec().trailing_windows))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window ") == 1 and plan.count("Sort ") == 1


def test_profile_reads_the_table_once(tx):
    plan = planned(user_profile(tx))
    assert plan.count("FileScan") == 1 and "Expand" not in plan and "Join" not in plan
    assert "ReadSchema: struct<user_id:bigint,country:string,device:string>" in plan


def test_score_without_hot_users_shuffles_rows_once(tx, no_broadcast):
    lines = executed(score(tx))
    # The hot branch and the split are gone, and one scan carries whole rows: its
    # exchange serves the windows and the join.
    assert sum("FileScan" in l and "timestamp" in l for l in lines) == 1
    assert sum("SortMergeJoin" in l for l in lines) == 1
    for gone in ("Union", "LeftAnti", "LeftSemi", "CartesianProduct", "NestedLoop"):
        assert not any(gone in l for l in lines), gone


def test_hot_users_are_counted_before_they_are_shuffled(tx, no_broadcast):
    df = score(tx, policy=SkewPolicy(min_rows=0))
    plan = planned(df)
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_dedup_reduces_before_the_shuffle(tx):
    plan = planned(prepare.dedup_by_id(tx))
    groups = [l for l in plan.splitlines() if "WindowGroupLimit" in l or "Exchange" in l]
    assert "Final" in groups[0] and "Exchange" in groups[1] and "Partial" in groups[2]


def test_top_per_user_reduces_before_the_shuffle(spark, tx):
    plan = planned(investigate.top_risk_per_user(stage(score(tx), "scored")))
    assert plan.count("WindowGroupLimit") == 2


def test_result_queries_prune_and_push_down(spark, tx):
    scored = stage(score(tx), "scored")
    top = planned(triage.top_cases(scored))
    assert "TakeOrderedAndProject" in top and "GreaterThanOrEqual(risk_score,70)" in top
    assert "ReadSchema: struct<amount:double,risk_score:int>" in planned(triage.kpis(scored))
    high = planned(triage.rows_of_level(scored))
    assert "EqualTo(risk_level,High)" in high


def test_patterns_read_the_table_once(spark, tx):
    scored = stage(score(tx), "scored")
    for query in (
        investigate.indicator_prevalence, investigate.indicator_pairs, investigate.geo_anomalies,
        investigate.customer_profile, investigate.coordinated_activity,
    ):
        plan = planned(query(scored))
        assert plan.count("FileScan") == 1, query.__name__
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
