"""The score in its long form: one leg per statistic and a join back by id.

Used to check the shorter plans of the library, and to time them against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plain_behaviour(tx: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.unix_timestamp("timestamp"))
    frequency = tx.select(
        "transaction_id", "user_id",
        (F.count("*").over(order.rangeBetween(-3600, 0)) - 1).alias("txn_count_1hr"),
        (F.count("*").over(order.rangeBetween(-86400, 0)) - 1).alias("txn_count_24hr"),
    )
    legs = []
    for column, plural in (("country", "countries"), ("device", "devices")):
        legs.append(
            tx.groupBy("user_id").agg(F.count_distinct(column).alias(f"distinct_{plural}_user"))
        )
        rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), column))
        legs.append(
            tx.groupBy("user_id", column).agg(F.count("*").alias("n"))
            .withColumn("rn", rank).filter("rn = 1")
            .select("user_id", F.col(column).alias(f"user_primary_{column}"))
        )
    for leg in legs:
        frequency = frequency.join(leg, "user_id", "left")
    return tx.join(frequency, ["transaction_id", "user_id"], "left")


def plain_score(tx: DataFrame) -> DataFrame:
    stats = tx.agg(
        F.percentile_approx("amount", 0.95).alias("p95"),
        F.avg("amount").alias("mean"),
        F.stddev("amount").alias("sd"),
    )
    c = F.col
    tests = {
        "high_amount": (c("amount") > c("p95"), 15),
        "extreme_amount": (c("amount") > c("mean") + 3 * c("sd"), 25),
        "high_frequency_1hr": (c("txn_count_1hr") >= 3, 20),
        "high_frequency_24hr": (c("txn_count_24hr") >= 10, 10),
        "multiple_countries": (c("distinct_countries_user") >= 3, 12),
        "unusual_country": (c("country") != c("user_primary_country"), 8),
        "multiple_devices": (c("distinct_devices_user") >= 3, 10),
        "unusual_device": (c("device") != c("user_primary_device"), 5),
        "unusual_hour": (c("hour").between(2, 4), 5),
    }
    flagged = plain_behaviour(tx).join(F.broadcast(stats)).select(
        "*", *[F.when(t, 1).otherwise(0).alias(f"indicator_{n}") for n, (t, _) in tests.items()]
    )
    points = sum((c(f"indicator_{n}") * w for n, (_, w) in tests.items()), F.lit(0))
    scored = flagged.withColumn("risk_score", F.least(F.lit(100), points)).drop("p95", "mean", "sd")
    return scored.withColumn(
        "risk_level",
        F.when(c("risk_score") <= 30, "Low").when(c("risk_score") <= 70, "Medium").otherwise("High"),
    )
