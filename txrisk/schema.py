"""Column names and types of the transaction and the scored table."""

from __future__ import annotations

from pyspark.sql import types as T

from txrisk.spec import INDICATOR_WEIGHTS

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("dayofweek", T.IntegerType()),
        T.StructField("coupon_applied", T.IntegerType()),
        T.StructField("num_items", T.IntegerType()),
        T.StructField("is_fraud", T.IntegerType()),
    ]
)

TRANSACTION_COLUMNS = TRANSACTIONS.fieldNames()
CATEGORICAL_COLUMNS = ["country", "device", "channel", "coupon_applied", "is_fraud"]
NUMERIC_COLUMNS = ["amount", "hour", "dayofweek", "num_items"]

BEHAVIOUR_COLUMNS = [
    "txn_count_1hr",
    "txn_count_24hr",
    "distinct_countries_user",
    "distinct_devices_user",
    "user_primary_country",
    "user_primary_device",
]
INDICATORS = list(INDICATOR_WEIGHTS)
INDICATOR_COLUMNS = [f"indicator_{name}" for name in INDICATORS]
SCORED_COLUMNS = (
    TRANSACTION_COLUMNS + BEHAVIOUR_COLUMNS + INDICATOR_COLUMNS + ["risk_score", "risk_level"]
)
TOP_RISK_COLUMNS = (
    ["transaction_id", "user_id", "amount", "country", "device", "channel", "hour"]
    + INDICATOR_COLUMNS
    + ["risk_score", "risk_level", "is_fraud"]
)
CASE_COLUMNS = [
    "transaction_id", "user_id", "timestamp", "amount", "country", "device", "channel",
    "risk_score", "is_fraud",
]
