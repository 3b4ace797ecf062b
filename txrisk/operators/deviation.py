"""How far a transaction is from its user's own habits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.skew import split_hot
from txrisk.spec import SkewPolicy


def _z(mean: Column, stddev: Column) -> Column:
    return F.round(F.try_divide(F.col("amount") - mean, stddev), 4).alias("amount_z")


def _flag(first: Column, name: str) -> Column:
    return F.when(F.col("timestamp") == first, 1).otherwise(0).alias(name)


def habits_by_window(df: DataFrame, first_uses: dict[str, str]) -> DataFrame:
    """One shuffle by user; each further window only sorts inside the partitions."""
    user = Window.partitionBy("user_id")
    out = df.select("*", _z(F.avg("amount").over(user), F.stddev_samp("amount").over(user)))
    for column, name in first_uses.items():
        first = F.min("timestamp").over(Window.partitionBy("user_id", column))
        out = out.select("*", _flag(first, name))
    return out


def habits_by_join(df: DataFrame, first_uses: dict[str, str]) -> DataFrame:
    """The same for hot users: aggregate, then look up.

    The statistics are one row per hot user and so as bounded as the hot users;
    the first uses are joined without a hint.
    """
    stats = df.groupBy(F.col("user_id").alias("_user")).agg(
        F.avg("amount").alias("_mean"), F.stddev_samp("amount").alias("_stddev")
    )
    names = [*df.columns, "amount_z"]
    out = df.join(
        F.broadcast(stats), F.col("user_id").eqNullSafe(F.col("_user")), "left"
    ).select(*df.columns, _z(F.col("_mean"), F.col("_stddev")))
    for column, name in first_uses.items():
        first = df.groupBy(F.col("user_id").alias("_user"), F.col(column).alias("_value")).agg(
            F.min("timestamp").alias("_first")
        )
        same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col(column).eqNullSafe(F.col("_value"))
        out = out.join(first, same, "left").select(*names, _flag(F.col("_first"), name))
        names.append(name)
    return out


def habits(
    df: DataFrame,
    first_uses: dict[str, str] | None = None,
    policy: SkewPolicy | None = SkewPolicy(),
) -> DataFrame:
    """``df`` with ``amount_z`` and a 0/1 column per entry of ``first_uses``.

    ``amount_z`` is the distance from the user's mean in the user's sample
    standard deviations, NULL when that is NULL or zero. ``first_uses`` maps a
    column to the name of its flag: is this when the user first shows the value?
    """
    first_uses = first_uses or {}
    if policy is None:
        return habits_by_window(df, first_uses)
    ordinary, hot = split_hot(df, "user_id", policy)
    return habits_by_window(ordinary, first_uses).unionByName(habits_by_join(hot, first_uses))
