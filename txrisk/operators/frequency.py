"""How many transactions a user made in the seconds before each transaction.

The frame counts whole seconds and includes all rows of the current second,
then takes off the row itself. NULL timestamps are peers of each other only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.skew import split_hot
from txrisk.spec import RiskSpec, SkewPolicy

SECONDS_PER_BIN = 86400


def trailing_by_window(df: DataFrame, windows: dict[str, int]) -> DataFrame:
    """One shuffle and one sort for all frames; for users that fit one task.

    The count inside a frame is the count up to its end less the count before its
    beginning. Both only grow along the sort, so the cost is linear in the rows,
    however many share a frame. NULL timestamps have nothing before them.
    """
    order = Window.partitionBy("user_id").orderBy(F.unix_timestamp("timestamp"))
    start = Window.unboundedPreceding
    until_now = F.count("*").over(order.rangeBetween(start, 0))

    def before(seconds: int) -> Column:
        earlier = F.count("*").over(order.rangeBetween(start, -(seconds + 1)))
        return F.when(F.col("timestamp").isNull(), 0).otherwise(earlier)

    return df.select(
        "*",
        *[
            (until_now - before(seconds) - 1).alias(name)
            for name, seconds in windows.items()
        ],
    )


# Whose and when, without NULLs, so that windows and joins share a partitioning.
USER = ["user_id IS NOT NULL AS _known", "coalesce(user_id, 0) AS _user"]
WHEN = ["timestamp IS NOT NULL AS _timed", "coalesce(unix_timestamp(timestamp), 0) AS _at"]
MOMENT = ["_known", "_user", "_timed", "_at"]


def trailing_by_second(df: DataFrame, windows: dict[str, int]) -> DataFrame:
    """The same counts for users of any size.

    A row enters the frame at its second and leaves it ``seconds + 1`` later, so
    the frame's content is a running sum of such changes. They are added up per
    user and second before the shuffle. The running sum goes over bins of a day
    (at most 86,400 seconds each) and gets the total of the earlier bins added.
    The rows then look their second up; adaptive execution can split that join.
    """
    names = list(windows)
    # (when, change per frame, is it an arrival)
    moves = [["_at", *["1L"] * len(names), "true"]] + [
        [f"_at + {seconds + 1}", *["-1L" if other == name else "0L" for other in names], "false"]
        for name, seconds in windows.items()
    ]
    stacked = ", ".join(value for move in moves for value in move)
    changes = (
        df.selectExpr(*USER, *WHEN)
        .selectExpr(
            "_known", "_user", "_timed",
            f"stack({len(moves)}, {stacked}) AS (_at, {', '.join(names)}, _arrival)",
        )
        .filter("_arrival OR _timed")
        .groupBy(*MOMENT)
        .agg(*[F.sum(name).alias(name) for name in names], F.max("_arrival").alias("_arrival"))
        .selectExpr("*", f"floor(_at / {SECONDS_PER_BIN}) AS _bin")
    )

    inside = "OVER (PARTITION BY _known, _user, _timed, _bin ORDER BY _at)"
    running = changes.selectExpr(
        *MOMENT, "_bin", "_arrival", *[f"sum({name}) {inside} AS {name}" for name in names]
    ).filter("_arrival")
    earlier = """OVER (PARTITION BY _known, _user, _timed ORDER BY _bin
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    # The same columns as above are read, so that Spark reuses the summed changes.
    carried = (
        changes.groupBy("_known", "_user", "_timed", "_bin")
        .agg(*[F.expr(f"sum(if(_arrival IS NULL, 0, {name})) AS _{name}") for name in names])
        .selectExpr(
            "_known", "_user", "_timed", "_bin",
            *[f"coalesce(sum(_{name}) {earlier}, 0) AS _{name}" for name in names],
        )
    )
    counts = running.join(carried, ["_known", "_user", "_timed", "_bin"]).selectExpr(
        *MOMENT, *[f"{name} + _{name} - 1 AS {name}" for name in names]
    )
    looked_up = df.selectExpr("*", *USER, *WHEN).join(counts, MOMENT, "left")
    return looked_up.select(*df.columns, *names)


def txn_frequency(
    df: DataFrame,
    windows: dict[str, int] | None = None,
    policy: SkewPolicy | None = SkewPolicy(),
) -> DataFrame:
    """``df`` with one trailing count per window; ``policy=None`` trusts the keys."""
    windows = windows or RiskSpec().trailing_windows
    if policy is None:
        return trailing_by_window(df, windows)
    ordinary, hot = split_hot(df, "user_id", policy)
    return trailing_by_window(ordinary, windows).unionByName(trailing_by_second(hot, windows))
