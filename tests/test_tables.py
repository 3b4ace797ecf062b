"""Clustered tables and lookups, versioned tables, incremental rescoring."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tests.frames import frame, row, same_rows
from txrisk.plans import investigate, lookup
from txrisk.plans.refresh import publish_scored, rescore
from txrisk.plans.scoring import score
from txrisk.schema import SCORED_COLUMNS
from txrisk.sources import versions
from txrisk.sources.clustered import of_users, write_clustered
from txrisk.sources.staging import stage


@pytest.fixture(scope="module")
def database(spark):
    name = f"tables_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


@pytest.fixture(scope="module")
def many(spark):
    """200,000 rows over three months; user 0 has a fourth of them, 1,000 others the rest."""
    n = F.col("id")
    user = F.when(n % 4 == 0, 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(1000)))
    columns = {c: F.lit(v) for c, v in (("country", "A"), ("device", "mobile"), ("channel", "web"), ("risk_level", "Low"))}
    return spark.range(200_000).select(
        n.alias("transaction_id"),
        user.cast("long").alias("user_id"),
        F.timestamp_seconds(1_704_067_200 + n * 37).alias("timestamp"),
        (n % 97).cast("double").alias("amount"),
        (n % 100).cast("int").alias("risk_score"),
        *[v.alias(c) for c, v in columns.items()],
    )


def rows_scanned(df) -> int:
    """Rows that the file scan of an executed frame gave out, before any filter."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_a_lookup_reads_few_rows(spark, many, database):
    table = f"{database}.clustered"
    write_clustered(many, table, files=12, row_group_bytes=64 << 10)
    plain = stage(many.repartition(12), "plain")
    for users in ([17], [3, 500, 999], [5000], list(range(100, 112))):
        found = of_users(spark.table(table), users)
        spread = of_users(plain, users)
        assert found.drop("event_month").exceptAll(spread).count() == 0
        # The plan as it ran, one stage without exchanges.
        found.collect(), spread.collect()
        assert rows_scanned(found) * 4 < rows_scanned(spread) or not rows_scanned(spread)
    explained = of_users(spark.table(table), [17])._jdf.queryExecution().toString()
    assert "PushedFilters" in explained and "In(user_id, [17])" in explained or "EqualTo(user_id,17)" in explained
    files = spark.table(table).filter("user_id = 0").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 3  # the hot user's rows are no single file


def test_lookups_answer_as_the_plans_for_all(spark, many, database):
    table = f"{database}.answers"
    rows = many.unionByName(many.limit(3).withColumn("user_id", F.lit(None).cast("long")))
    write_clustered(rows, table, files=6)
    named = F.col("user_id").isin(0, 7, 8)
    assert same_rows(lookup.timeline_of_users(spark, table, [8, 7, 0, 7]), investigate.customer_timeline(rows).filter(named))
    assert same_rows(lookup.profile_of_users(spark, table, [0, 7, 8]), investigate.customer_profile(rows).filter(named))
    assert same_rows(lookup.worst_of_users(spark, table, [0, 7, 8]), investigate.top_risk_per_user(rows).filter(named))
    one = lookup.profile_of_users(spark, table, [7], months=("2024-02", "2024-02"))
    assert same_rows(one, investigate.customer_profile(rows.filter("date_format(timestamp, 'yyyy-MM') = '2024-02'")).filter("user_id = 7"))
    assert lookup.timeline_of_users(spark, table, []).count() == 0
    assert lookup.timeline_of_users(spark, table, [None, -1]).count() == 0
    assert [r["user_id"] for r in lookup.timeline_of_users(spark, table, [8, 7]).collect()] == sorted(
        r["user_id"] for r in lookup.timeline_of_users(spark, table, [7, 8]).collect()
    )


class Crash(Exception):
    pass


def test_readers_see_the_old_version_until_the_new_one_is_whole(spark, database, monkeypatch):
    table = f"{database}.versioned"
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "user_id long, v string")
    new = spark.createDataFrame([(k, "new") for k in range(50)], "user_id long, v string")
    versions.publish(old, table, buckets=8)
    reading = spark.table(table)
    assert same_rows(reading, old)
    whole = versions.write_buckets

    def cut_short(*args):
        whole(*args)
        raise Crash

    def never(*args):
        raise Crash

    for name, step in (("write_buckets", never), ("write_buckets", cut_short), ("point_to", never)):
        with monkeypatch.context() as m:
            m.setattr(versions, name, step)
            with pytest.raises(Crash):
                versions.publish(new, table, buckets=8)
        assert same_rows(spark.table(table), old)
    left = versions.vacuum(spark, table)
    assert len(left) == 2 and same_rows(spark.table(table), old)
    versions.publish(new, table, buckets=8)
    assert same_rows(spark.table(table), new)
    assert same_rows(reading, old)  # a reader of the version before goes on
    # From itself, and to nothing.
    versions.publish(spark.table(table).filter("user_id < 3"), table, buckets=8)
    assert spark.table(table).count() == 3
    assert versions.vacuum(spark, table) and spark.table(table).count() == 3
    versions.publish(new.limit(0), table, buckets=8)
    assert spark.table(table).count() == 0 and spark.table(table).columns == ["user_id", "v"]
    with pytest.raises(ValueError, match="buckets"):
        versions.publish(new, table, buckets=9)


def history(spark):
    rows = [row(100 + k, user=k % 7, when=600.0 * k, amount=float(k % 50), country="AB"[k % 11 == 0]) for k in range(300)]
    return frame(spark, *rows, row(90, user=None), row(91, user=None, when=None))


def test_rescoring_equals_scoring_all(spark, database):
    table, tx = f"{database}.scored_a", history(spark)
    publish_scored(tx, table, exact=True, buckets=8)
    assert spark.table(table).columns == SCORED_COLUMNS
    assert same_rows(spark.table(table), score(tx, exact=True))
    arrived = frame(
        spark,
        row(900, user=3, when=180_100.0, amount=900.0, country="C"),
        row(901, user=77, when=1.0, amount=1.0),
        row(902, user=None, when=5.0),
    )
    rescore(spark, table, arrived)
    assert same_rows(spark.table(table), score(tx.unionByName(arrived), exact=True))
    with pytest.raises(ValueError, match="is in .*scored_a already"):
        rescore(spark, table, arrived)
    rescore(spark, table, arrived.limit(0))
    assert same_rows(spark.table(table), score(tx.unionByName(arrived), exact=True))


def test_rescoring_leaves_other_buckets_alone(spark, database):
    """Amounts that are NULL change no statistics, so only the users' buckets are written."""
    table, tx = f"{database}.scored_b", history(spark)
    publish_scored(tx, table, exact=True, buckets=8)
    before = versions.state_of(spark, table)
    arrived = frame(spark, *[row(900 + k, user=3, when=180_000.0 + k, amount=None, country="D") for k in range(4)])
    rescore(spark, table, arrived)
    after = versions.state_of(spark, table)
    assert after.facts == before.facts
    changed = set(after.paths()) - set(before.paths())
    assert len(changed) == 1 and len(after.paths()) == len(before.paths()) > 3
    assert same_rows(spark.table(table), score(tx.unionByName(arrived), exact=True))
    assert versions.vacuum(spark, table)
    assert same_rows(spark.table(table), score(tx.unionByName(arrived), exact=True))


def test_a_crash_while_rescoring_changes_nothing(spark, database, monkeypatch):
    table, tx = f"{database}.scored_c", history(spark)
    publish_scored(tx, table, exact=True, buckets=4)
    before = spark.table(table).collect()

    def never(*args):
        raise Crash

    monkeypatch.setattr(versions, "point_to", never)
    with pytest.raises(Crash):
        rescore(spark, table, frame(spark, row(900, user=3, when=1.0)))
    assert sorted(spark.table(table).collect(), key=str) == sorted(before, key=str)
