"""Steps that moved more rows, or did more work for a row, than they need."""

from __future__ import annotations

from checks.queries import _with_copies
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.frames import frame, row
from txrisk.operators import prepare
from txrisk.spec import SkewPolicy

NUMBERS = T.StructType([T.StructField("n", T.IntegerType())])


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_become_whole_numbers_without_decimals_where_they_can(spark):
    want = {
        "1": 1, "-1": -1, "+5": 5, " 7 ": 7, "00012": 12, "12.0": 12, "1e3": 1000, "1.5e1": 15, "true": 1, " False ": 0,
        "2147483647": 2147483647, "2147483648": None, "12.5": None, "1e-1": None, "": None, "A": None, "-": None, "9\x7f": None,
        "٣": 3,
    }
    df = spark.createDataFrame([(k, k) for k in want], "text string, n string")
    typed = prepare.cast_to_schema(df, NUMBERS, lenient=True)
    assert {r["text"]: r["n"] for r in typed.collect()} == want
    # The decimal is the last resort, and not one of texts without a digit.
    assert r"RLIKE(n" in plan(typed).split("try_cast")[0] and r"\p{Nd}" in plan(typed)


def test_audit_is_the_same_for_hot_ids(spark):
    rows = [row(k % 7, user=k % 3, when=float(k % 5), amount=None if k % 11 == 0 else 1.0) for k in range(120)]
    df = frame(spark, *rows, row(None, user=1), row(None, user=1), row(50, user=None), row(60), row(60))
    audits = [prepare.dedup_audit(df, policy).collect() for policy in (SkewPolicy(), SkewPolicy(min_rows=0), SkewPolicy(min_rows=17))]
    assert len({frozenset(map(tuple, a)) for a in audits}) == 1 and len({len(a) for a in audits}) == 1
    kept = prepare.dedup_by_id(df).count()
    assert sum(r["removed_copies"] for r in audits[0]) == df.count() - kept
    assert {r["is_conflict"] for r in audits[0]} == {True, False}


def test_copies_come_from_one_pass_over_the_rows(spark):
    df = frame(spark, *[row(k) for k in range(4)]).withColumn("num_items", F.col("transaction_id").cast("int") * 10)
    df = df.unionByName(df.limit(1).withColumn("num_items", F.lit(None).cast("int")))
    copied = _with_copies(df)
    assert copied.columns == df.columns
    assert sorted(r["num_items"] or -1 for r in copied.collect()) == [-1, -1, 10, 20, 30, 30]
    assert plan(copied).count("Union") == plan(df).count("Union")
