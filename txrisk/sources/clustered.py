"""Tables whose rows of one user lie together, for looking up single customers.

Inside a month the rows are range-sorted by user, then time. A user's rows are in one file, or in a few
that follow each other: the ranges cut between two moments of a hot user too. Each file has Parquet
Bloom filters on the user beside the minima and maxima of its row groups and pages.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH = "event_month"
#: Parquet takes lists of up to so many values as they are; longer ones become one range.
PUSHED_VALUES = 10


def write_clustered(
    df: DataFrame,
    table: str,
    user: str = "user_id",
    time: str = "timestamp",
    files: int | None = None,
    users_expected: int = 1_000_000,
    row_group_bytes: int = 16 << 20,
) -> None:
    """Create or overwrite ``table``, partitioned by month and sorted by user and time in each month.

    ``files`` is how many ranges of rows there are over all months, by default the number of shuffle
    partitions; sampling makes them of about equal size, whatever the users' sizes. ``users_expected``
    is for the size of one file's Bloom filter. Rows without a user come first, those without a time are a
    month of their own.
    """
    spark = df.sparkSession
    order = [MONTH, user, time]
    ranges = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(MONTH, F.date_format(time, "yyyy-MM")).repartitionByRange(ranges, *order)
    options = {
        f"parquet.bloom.filter.enabled#{user}": "true",
        f"parquet.bloom.filter.expected.ndv#{user}": str(users_expected),
        "parquet.block.size": str(row_group_bytes),
    }
    writer = rows.sortWithinPartitions(*order).write.mode("overwrite").format("parquet")
    writer.options(**options).partitionBy(MONTH).saveAsTable(table)


def of_users(rows: DataFrame, users: list[int], user: str = "user_id") -> DataFrame:
    """The rows of the named users; the condition reaches the files' Bloom filters and statistics.

    The users are tested in lists short enough to be pushed down as they are. Naming very many users
    makes a long condition; a join is the way then.
    """
    known = sorted({u for u in users if u is not None})
    if not known:
        return rows.limit(0)
    parts = [known[k : k + PUSHED_VALUES] for k in range(0, len(known), PUSHED_VALUES)]
    lists: list[Column] = [F.col(user).isin(part) for part in parts]
    return rows.filter(reduce(or_, lists))
