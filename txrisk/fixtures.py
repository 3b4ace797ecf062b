"""The transaction view over the test tables ``events`` and ``nation``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TX_SQL = r"""
WITH e AS (
  SELECT event_id, ts, value, event_type, user_id div 4 AS uid,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM {events}
), g AS (
  SELECT *, CAST(CASE WHEN k < 12 AND uid % 3 = 0 THEN (uid + 1 + k) % 25
                      WHEN k < 12 THEN (uid + 1) % 25
                      ELSE uid % 25 END AS INT) AS nk
  FROM e
)
SELECT event_id AS transaction_id, uid AS user_id, CAST(ts AS TIMESTAMP) AS timestamp,
       value AS amount, n_name AS country,
       CASE WHEN k BETWEEN 12 AND 19 THEN 'desktop'
            WHEN k BETWEEN 20 AND 24 AND uid % 4 = 0 THEN 'tablet'
            ELSE 'mobile' END AS device,
       event_type AS channel, hour(ts) AS hour, weekday(ts) AS dayofweek,
       k % 2 AS coupon_applied, 1 + k % 5 AS num_items,
       CASE WHEN (value > 140 AND k % 2 = 0) OR k = 7 THEN 1 ELSE 0 END AS is_fraud
FROM g JOIN {nation} ON nk = n_nationkey
"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        TX_SQL,
        events=spark.read.parquet(f"{sf_dir}/events.parquet"),
        nation=spark.read.parquet(f"{sf_dir}/nation.parquet"),
    )
