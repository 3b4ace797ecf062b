"""Questions about named customers, over a table that ``write_clustered`` has written.

Each reads the row groups that hold the named users' rows, not the table. The answers are those that the
plans of ``investigate`` give for all users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txrisk.plans import investigate
from txrisk.sources.clustered import MONTH, of_users
from txrisk.spec import SkewPolicy


def rows_of_users(
    spark: SparkSession, table: str, users: list[int], months: tuple[str, str] | None = None
) -> DataFrame:
    """All columns of the users' rows, within the first and last month if named (``yyyy-MM``)."""
    rows = spark.table(table)
    if months:
        rows = rows.filter(rows[MONTH].between(*months))
    return of_users(rows, users).drop(MONTH)


def timeline_of_users(
    spark: SparkSession, table: str, users: list[int], months: tuple[str, str] | None = None
) -> DataFrame:
    """The users' transactions with the seconds since the one before, sorted by user and time.

    With ``months`` the first row has no row before it, as earlier months are not read."""
    rows = rows_of_users(spark, table, users, months)
    found = investigate.customer_timeline(rows, policy=SkewPolicy())
    return found.orderBy("user_id", "timestamp", "transaction_id")


def profile_of_users(
    spark: SparkSession, table: str, users: list[int], months: tuple[str, str] | None = None
) -> DataFrame:
    """The users' profiles; within ``months`` the profile of those months."""
    return investigate.customer_profile(rows_of_users(spark, table, users, months))


def worst_of_users(
    spark: SparkSession, table: str, users: list[int], n: int = 3, months: tuple[str, str] | None = None
) -> DataFrame:
    """The users' ``n`` worst transactions each."""
    return investigate.top_risk_per_user(rows_of_users(spark, table, users, months), n)
