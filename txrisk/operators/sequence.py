"""The transaction before each transaction of a user, by time, id and the carried columns.

Rows that agree in all of these are interchangeable, so the order is total for
what is asked, and both plans give the same answer whatever a user's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.skew import split_hot
from txrisk.spec import SkewPolicy

ORDER = ["timestamp", "transaction_id"]
SECONDS_PER_BIN = 86400
HIGH_BITS, MIDDLE_BITS, LOW_BITS = 22, 21, 21  # of a 64-bit id
BEFORE_ALL = -(2**62)  # rows without an id come first


def _order(columns: list[str]) -> list[str]:
    return [*ORDER, *(c for c in columns if c not in ORDER)]


def previous_by_window(df: DataFrame, columns: list[str]) -> DataFrame:
    by_time = Window.partitionBy("user_id").orderBy(*_order(columns))
    return df.select("*", F.lag(F.struct(*_order(columns))).over(by_time).alias("previous"))


# Nested groups of a user's rows, outermost first. Each level has a bounded number
# of members in a group of the level above, however the ids are chosen: days of a
# history, seconds of a day, microseconds of a second, then the high and the middle
# bits of the ids at one time. Rows that differ in the low bits only are sorted.
LEVELS = [["user_id"], ["_timed", "_day"], ["_second"], ["_time"], ["_high"], ["_middle"]]


def previous_by_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same for users of any size.

    Inside a group the member before is found by a window over its bounded
    members; the first member takes the last row of the group before, found in
    the same way one level up.
    """
    keyed = (
        df.select("*", F.struct(*_order(columns)).alias("_row"))
        .selectExpr(
            "*",
            "timestamp IS NOT NULL AS _timed",
            "coalesce(unix_timestamp(timestamp), 0) AS _second",
            "coalesce(timestamp, timestamp_seconds(0)) AS _time",
            f"coalesce(shiftright(transaction_id, {MIDDLE_BITS + LOW_BITS}), {BEFORE_ALL}) AS _high",
            f"coalesce(shiftright(transaction_id, {LOW_BITS}) & {2**MIDDLE_BITS - 1}, 0) AS _middle",
        )
        .selectExpr("*", f"floor(_second / {SECONDS_PER_BIN}) AS _day")
    )
    before: DataFrame | None = None
    for depth in range(1, len(LEVELS)):
        outer = [c for level in LEVELS[:depth] for c in level]
        inner = outer + LEVELS[depth]
        members = keyed.groupBy(*inner).agg(F.max("_row").alias("_last"))
        lag = F.lag("_last").over(Window.partitionBy(*outer).orderBy(*LEVELS[depth]))
        found = members.select(*inner, lag.alias("_before"))
        before = found if before is None else _or_from_above(found, before, outer, inner)
    by_id = Window.partitionBy(*inner).orderBy(*_order(columns))
    rows = keyed.select(*df.columns, *inner[1:], F.lag("_row").over(by_id).alias("_before"))
    return _or_from_above(rows, before, inner, df.columns).withColumnRenamed("_before", "previous")


def _or_from_above(
    members: DataFrame, groups: DataFrame, keys: list[str], keep: list[str]
) -> DataFrame:
    above = groups.withColumnRenamed("_before", "_above")
    return members.join(above, keys).select(
        *keep, F.coalesce("_before", "_above").alias("_before")
    )


def previous_row(
    df: DataFrame, columns: list[str], policy: SkewPolicy | None = SkewPolicy()
) -> DataFrame:
    """``df`` with a struct ``previous`` (time, id and ``columns`` of the row before
    of the same user); rows without a user have no history and are left out."""
    owned = df.filter(F.col("user_id").isNotNull())
    if policy is None:
        return previous_by_window(owned, columns)
    ordinary, hot = split_hot(owned, "user_id", policy)
    return previous_by_window(ordinary, columns).unionByName(previous_by_levels(hot, columns))
