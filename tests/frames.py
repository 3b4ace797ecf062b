"""Hand-made transactions for the edge cases."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from txrisk.schema import TRANSACTION_COLUMNS, TRANSACTIONS

START = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def row(id, user=1, when=0.0, **more):
    values = {
        "transaction_id": id,
        "user_id": user,
        "timestamp": None if when is None else at(when),
        "amount": 10.0,
        "country": "A",
        "device": "mobile",
        "channel": "web",
        "hour": 12,
        "dayofweek": 0,
        "coupon_applied": 0,
        "num_items": 1,
        "is_fraud": 0,
    }
    values.update(more)
    return tuple(values[c] for c in TRANSACTION_COLUMNS)


def frame(spark: SparkSession, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), TRANSACTIONS)


def by_id(df: DataFrame) -> dict:
    return {r["transaction_id"]: r for r in df.collect()}


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets, with columns matched by name."""
    b = b.select(*a.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
