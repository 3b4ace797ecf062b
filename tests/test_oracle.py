"""Every query of the core against its DuckDB oracle; tests/llm has those of the corpus operators."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from checks.compare import difference
from checks.oracle import oracle_sql
from checks.queries import queries

QUERIES, SQL = queries(), oracle_sql()


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), sf_dir, SQL[name]) is None


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["risk_level", "total_transactions", "actual_fraud", "fraud_rate_percent"]
    assert {r["risk_level"]: r["fraud_rate_percent"] for r in result.collect()} == {
        "Low": 2.54, "Medium": 18.28, "High": 0.0,
    }
