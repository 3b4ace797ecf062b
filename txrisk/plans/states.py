"""Customer profiles that are kept up month by month.

A state has what a user did in a month, in a form that adds up: counts and sums, a mask of the days, and for
each numbered column a mask of its values in words of 64 bits. States of later rows are merged into those
at hand, and profiles are cut from states without reading a transaction. Distinct counts are exact and need
no expansion of the rows: they are bits of masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.bands import money_cents

COLUMNS = ("country", "device")
#: Values of a numbered column at most: masks have a word for every 64.
MOST_VALUES = 1024
LEVELS = ("High", "Medium", "Low")
KEYS = ["user_id", "month"]

Numbers = dict[str, dict[str, int]]


def number_values(
    df: DataFrame, known: Numbers | None = None, columns: tuple[str, ...] = COLUMNS, most: int = MOST_VALUES
) -> Numbers:
    """Numbers for the values of each column; values in ``known`` keep theirs, as stored masks need it.

    At most ``most`` values of a column come to the driver; a column with more is refused, and
    ``investigate.customer_profile`` counts its values without numbers.
    """
    found: Numbers = {}
    for column in columns:
        numbers = dict((known or {}).get(column, {}))
        values = df.filter(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
        for value in sorted(r[0] for r in values if r[0] not in numbers):
            numbers[value] = len(numbers)
        if len(numbers) > most:
            raise ValueError(f"{column} has more than {most} values")
        found[column] = numbers
    return found


def _words(numbers: dict[str, int]) -> int:
    return max(1, -(-len(numbers) // 64))


def _masks(column: str, numbers: dict[str, int]) -> list[Column]:
    """A word per 64 values, with the bit of the row's value."""
    if not numbers:
        return [F.lit(0).cast("long").alias(f"{column}_0")]
    table = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    number = F.element_at(table, F.col(column))
    return [
        F.when(F.floor(number / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (number % 64).cast("int"))).alias(f"{column}_{w}")
        for w in range(_words(numbers))
    ]


def monthly_states(scored: DataFrame, numbers: Numbers, indicators: list[str] | None = None) -> DataFrame:
    """One row per user and month; rows without a user have none, those without a time a month NULL."""
    masks = [m for c, own in numbers.items() for m in _masks(c, own)]
    names = [f"{c}_{w}" for c, own in numbers.items() for w in range(_words(own))]
    day = F.call_function("shiftleft", F.lit(1), F.dayofmonth("timestamp") - 1).alias("days")
    level = F.col("risk_level")
    flags = indicators or []
    rows = scored.filter(F.col("user_id").isNotNull()).select(
        "user_id", F.trunc("timestamp", "month").alias("month"), "timestamp", "amount", "risk_score",
        "risk_level", day, *masks, *flags,
    )
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.sum("amount").alias("amount"),
        F.count("amount").alias("amounts"),
        F.max("amount").alias("max_amount"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.sum(F.col("risk_score").cast("long")).alias("score"),
        F.count("risk_score").alias("scores"),
        F.max("risk_score").alias("max_score"),
        *[F.count_if(level == x).alias(f"{x.lower()}_count") for x in LEVELS],
        *[F.sum(F.col(c).cast("long")).alias(c) for c in flags],
        *[F.coalesce(F.bit_or(c), F.lit(0)).alias(c) for c in ["days", *names]],
    )


SUMMED = ("n", "amount", "amounts", "score", "scores", *[f"{x.lower()}_count" for x in LEVELS])


def _merged(states: DataFrame, masks: list[str], keys: list[str]) -> DataFrame:
    def one(name: str) -> Column:
        if name in masks:
            return F.bit_or(F.coalesce(name, F.lit(0)))  # columns that older states lack
        if name == "first_seen":
            return F.min(name)
        if name.startswith("max_") or name == "last_seen":
            return F.max(name)
        return F.sum(name)

    values = [c for c in states.columns if c not in KEYS]
    return states.groupBy(*keys).agg(*[one(c).alias(c) for c in values])


def _mask_names(states: DataFrame, numbers: Numbers) -> list[str]:
    return ["days", *[f"{c}_{w}" for c, own in numbers.items() for w in range(_words(own))]]


def merge_states(states: DataFrame, later: DataFrame, numbers: Numbers) -> DataFrame:
    """The states of all rows from those of two sets of rows; ``numbers`` are the later, larger ones."""
    both = states.unionByName(later, allowMissingColumns=True)
    return _merged(both, _mask_names(both, numbers), KEYS)


def profiles(states: DataFrame, numbers: Numbers) -> DataFrame:
    """What ``investigate.customer_profile`` gives, from one state per user and month."""
    masks = _mask_names(states, numbers)
    by_month = states.withColumn("days_active", F.bit_count("days")).drop("days", "month")
    values = [c for c in by_month.columns if c not in KEYS]
    per_user = _merged(by_month.select("user_id", *values), masks, ["user_id"])
    total = F.round("amount", 2)

    def distinct(column: str) -> Column:
        words = [F.bit_count(f"{column}_{w}") for w in range(_words(numbers[column]))]
        return sum(words[1:], words[0]).cast("long").alias(PLURAL.get(column, f"distinct_{column}"))

    return per_user.select(
        "user_id",
        F.col("n").alias("transaction_count"),
        F.col("days_active").cast("long").alias("days_active"),
        total.alias("total_amount"),
        money_cents(total, F.col("amounts")).alias("avg_amount"),
        "max_amount",
        *[distinct(c) for c in numbers],
        "first_seen",
        "last_seen",
        "max_score",
        F.round(F.try_divide(F.col("score"), F.col("scores")), 4).alias("avg_score"),
        *[f"{x.lower()}_count" for x in LEVELS],
    )


PLURAL = {"country": "distinct_countries", "device": "distinct_devices"}
