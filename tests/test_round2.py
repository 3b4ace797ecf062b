"""Linear trailing counts, total order of sequences, whole numbers, crash-safe tables, NaN amounts."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from txrisk.operators import prepare
from txrisk.operators.amounts import amount_stats
from txrisk.operators.frequency import txn_frequency
from txrisk.operators.profile import distinct_rows, summary_stats
from txrisk.operators.sequence import HIGH_BITS, LOW_BITS, MIDDLE_BITS, previous_row
from txrisk.plans import investigate
from txrisk.plans.scoring import score
from txrisk.sources.tables import recover_table, replace_table
from txrisk.spec import SkewPolicy

PLANS = [None, SkewPolicy(), SkewPolicy(min_rows=0)]


def test_dense_user_day_is_linear(spark):
    rows = spark.range(95_000).selectExpr("id", "1L AS user_id", "timestamp_seconds(id % 86400) AS timestamp")
    began = time.time()
    sums = {
        tuple(txn_frequency(rows, policy=p).agg(F.sum("txn_count_1hr"), F.sum("txn_count_24hr")).first()) for p in PLANS
    }
    assert len(sums) == 1
    assert time.time() - began < 40


def test_trailing_counts_with_null_times(spark):
    rows = spark.sql("SELECT 1L AS user_id, timestamp_seconds(t) AS timestamp FROM VALUES (NULL), (NULL), (0), (3600), (7201) v(t)")
    for p in PLANS:
        found = txn_frequency(rows, policy=p).select("txn_count_1hr").collect()
        assert sorted(r[0] for r in found) == [0, 0, 1, 1, 1]


def test_sequence_has_one_order_on_ties(spark):
    rows = spark.sql(
        "SELECT 1L AS user_id, timestamp_seconds(t) AS timestamp, CAST(NULL AS BIGINT) AS transaction_id, country "
        "FROM VALUES (0, 'Z'), (0, 'A'), (1, 'B') v(t, country)"
    )
    for p in PLANS:
        last = previous_row(rows, ["country"], p).filter("country = 'B'").select("previous.country").first()[0]
        assert last == "Z"


def test_fractions_are_rejected(spark):
    raw = spark.createDataFrame([("1.2", "x"), ("1.8", "y"), ("3.0", "z"), (None, "n")], "transaction_id string, o string")
    schema = prepare.TRANSACTIONS.__class__([f for f in prepare.TRANSACTIONS if f.name == "transaction_id"])
    typed = prepare.cast_to_schema(raw, schema, lenient=True)
    assert {(r.transaction_id, r.o) for r in typed.collect()} == {(None, "x"), (None, "y"), (3, "z"), (None, "n")}
    assert prepare.reject_counts(raw, schema).collect() == [("transaction_id", 2)]
    with pytest.raises(Exception, match="whole number"):
        prepare.cast_to_schema(raw, schema).collect()


def test_small_fractions_are_rejected(spark):
    schema = prepare.TRANSACTIONS.__class__([f for f in prepare.TRANSACTIONS if f.name == "transaction_id"])
    whole = ["5", " +5.000000000 ", "5.", "-0", "1.5e1", "15E-0", "1500e-2", "0e-9", ".0", "12.0", "9007199254740993"]
    cut = ["5.0000004", "4.9999999999999", "-5." + "0" * 30 + "1", "1.55e1", "15e-1", "1e-9", ".0000001", "1e-99999999999"]
    raw = spark.createDataFrame([(x,) for x in [*whole, *cut, "x", None]], "transaction_id string")
    found = [r[0] for r in prepare.cast_to_schema(raw, schema, lenient=True).collect()]
    assert found == [5, 5, 5, 0, 15, 15, 15, 0, 0, 12, 9007199254740993] + [None] * (len(cut) + 2)
    assert prepare.reject_counts(raw, schema).collect() == [("transaction_id", len(cut) + 1)]
    for kind, value in (("double", "5.0000004"), ("float", "1e-7"), ("decimal(38,18)", "5.000000000000000001")):
        one = spark.sql(f"SELECT CAST(v AS {kind}) AS transaction_id FROM VALUES ('{value}'), ('5') t(v)")
        assert [r[0] for r in prepare.cast_to_schema(one, schema, lenient=True).collect()] == [None, 5]
        with pytest.raises(Exception, match="whole number"):
            prepare.cast_to_schema(one, schema).collect()
    with pytest.raises(Exception, match="whole number"):
        prepare.cast_to_schema(raw.filter("transaction_id = '5.0000004'"), schema).collect()


def test_replace_table_refuses_leftovers_and_recovers(spark):
    replace_table(spark.range(3), "crash_test")
    spark.range(5).write.saveAsTable("crash_test__staging")
    with pytest.raises(RuntimeError, match="recover_table"):
        replace_table(spark.range(5), "crash_test")
    spark.sql("ALTER TABLE crash_test RENAME TO crash_test__old")
    recover_table(spark, "crash_test")
    assert spark.table("crash_test").count() == 3
    replace_table(spark.table("crash_test").filter("id > 0"), "crash_test")
    assert spark.table("crash_test").count() == 2
    spark.sql("DROP TABLE crash_test")


def test_histogram_with_nan(spark):
    rows = spark.sql("SELECT CAST(a AS DOUBLE) AS amount FROM VALUES ('1'), ('2'), ('21'), ('NaN'), (NULL) v(a)")
    found = {r.bin: (r.transaction_count, r.bin_from) for r in investigate.amount_histogram(rows).collect()}
    assert found[0] == (1, None) and found[1] == (1, 1.0) and sum(n for n, _ in found.values()) == 4


def test_approximate_summary_is_near_the_exact(spark, tx):
    exact, fast = (summary_stats(tx, exact=e).orderBy("column").collect() for e in (True, False))
    for a, b in zip(exact, fast, strict=True):
        assert a["column"] == b["column"] and a["count"] == b["count"]
        assert all(abs(x - y) <= 0.05 * abs(x) + 1 for x, y in zip(a[4:], b[4:], strict=True))


def test_broadcast_bound_is_checked():
    with pytest.raises(ValueError, match="broadcast"):
        SkewPolicy(max_keys=10**9)


def test_hashed_ids_at_one_moment(spark):
    rows = spark.range(20_000).selectExpr(
        "1L AS user_id", "timestamp_seconds(0) AS timestamp", "xxhash64(id) AS transaction_id", "id AS n"
    )
    rows = rows.unionByName(rows.limit(1).selectExpr("user_id", "timestamp", "CAST(NULL AS BIGINT) AS transaction_id", "-1L AS n"))
    found = [
        {tuple(r) for r in previous_row(rows, ["n"], p).select("n", "previous.n").collect()} for p in PLANS
    ]
    assert len(found[0]) == 20_001 and found[0] == found[1] == found[2]
    # No group has more members than the bits that tell them apart.
    assert HIGH_BITS + MIDDLE_BITS + LOW_BITS == 64 and max(HIGH_BITS, MIDDLE_BITS, LOW_BITS) <= 22


def test_quantiles_of_one_series_need_no_nested_loop(spark, tx):
    for df in (amount_stats(tx, exact=True), score(tx, exact=True, policy=None)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_values_of_users_are_rows(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (1L, 'a'), (1L, 'b'), (1L, 'b'), (1L, NULL), (2L, 'a'), (NULL, 'c') v(user_id, device)"
    )
    found = investigate.values_of_users(rows, "device", minimum=2).collect()
    assert sorted(map(tuple, found)) == [(1, "a", 1, 2, 3), (1, "b", 2, 2, 3)]


def test_distinct_rows(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, NULL), (1, NULL), (1, 'a'), (NULL, NULL) v(a, b)")
    assert distinct_rows(rows).count() == 3 and distinct_rows(rows.limit(0)).count() == 0
