"""What the scored table is made from."""

from __future__ import annotations

from datetime import timedelta

import pytest
from checks import queries
from txrisk.fixtures import transactions
from txrisk.plans import investigate
from txrisk.plans.scoring import score

from tests.frames import START, same_rows

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture
def folder(spark, tmp_path):
    """Events with an event that comes twice and NULL users, values and texts, and nations, one of them named twice."""
    events = [
        (k, START + timedelta(hours=7 * k), None if k % 13 == 0 else k % 24, "view", None if k % 11 == 0 else float(k), None if k % 17 == 0 else f'{{"k": {k % 40}}}')
        for k in range(120)
    ]
    spark.createDataFrame([*events, events[5]], EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    nations = [(k, f"N{k}") for k in range(25)]
    spark.createDataFrame([*nations, nations[2]], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["customer_profile_from_states", "indicators"])
def test_a_score_reads_stored_transactions(spark, folder, monkeypatch, name):
    """Each of its passes over events would parse and join every row again."""
    inputs = []
    monkeypatch.setattr(queries, "score", lambda tx, **options: inputs.append(tx) or score(tx, **options))
    for _ in range(2):
        queries.queries()[name](spark, folder)
    assert inputs and not [f for tx in inputs for f in tx.inputFiles() if f"{folder}/" in f]
    assert len({f for tx in inputs for f in tx.inputFiles()}) == len(inputs[0].inputFiles())
    assert inputs[0].columns == transactions(spark, folder).columns and same_rows(inputs[0], transactions(spark, folder))


def test_profiles_from_states_of_the_stored_table(spark, folder):
    found = queries.queries()["customer_profile_from_states"](spark, folder)
    assert same_rows(found, investigate.customer_profile(score(transactions(spark, folder), exact=True)))
