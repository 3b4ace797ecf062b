"""Which columns of which tables hold the same values, whatever their names.

A column is contained in another when most of its distinct values are values of the other: that is what a
foreign key looks like. From each column a bottom-k sample of its distinct values is taken and looked
up among all columns; only pairs whose sample says that they may reach the bound are counted in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from txrisk.functions.bands import ratio
from txrisk.sources.staging import stage

SAMPLE = 256
#: How much less than the bound a sample's share may be: over five standard deviations at SAMPLE values.
SLACK = 0.15


def _kind(kind: T.DataType) -> str | None:
    """Columns of one kind are compared; numbers with fractions are no keys."""
    if isinstance(kind, T.IntegralType):
        return "number"
    if isinstance(kind, T.StringType):
        return "text"
    return "day" if isinstance(kind, T.DateType) else None


def column_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, table, column, value hash), distinct, for the columns that may be keys; NULL is no value.

    Every table is read once. Two hashes make 128 bits, so that different values are told apart.
    """
    parts = []
    for name, df in tables.items():
        kinds = [(f.name, k) for f in df.schema if (k := _kind(f.dataType))]
        if not kinds:
            continue
        text = [F.col(f"`{c}`").cast("string") for c, _ in kinds]
        cells = [
            F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), F.xxhash64(v).alias("hash"),
                     F.crc32(F.encode(v, "utf-8")).alias("check"), v.isNull().alias("missing"))
            for (c, k), v in zip(kinds, text, strict=True)
        ]
        parts.append(df.select(F.lit(name).alias("table"), F.inline(F.array(*cells))).filter("NOT missing").drop("missing"))
    if not parts:
        raise ValueError("no column that may be a key")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.distinct()


def discovered_links(
    tables: dict[str, DataFrame], min_containment: float = 0.9, min_values: int = 20, sample: int = SAMPLE
) -> DataFrame:
    """Pairs of columns of different tables of which the left one's distinct values are contained in the
    right one's: (left_table, left_column, right_table, right_column, left_values, shared_values, containment).

    Columns of fewer than ``min_values`` distinct values link with everything and are left out on both
    sides. The sample is ``sample`` values a column, so as many rows as columns in the catalog times that.
    """
    own = ["kind", "table", "column"]
    values = stage(column_values(tables), "values")
    sizes = values.groupBy(*own).agg(F.count("*").alias("size")).filter(F.col("size") >= min_values)
    values = values.join(F.broadcast(sizes), own)  # one row per column
    order = Window.partitionBy(*own).orderBy("hash", "check")
    chosen = values.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample)
    left = [F.col(c).alias(f"left_{c}") for c in ("table", "column", "size")]
    asked = chosen.select("kind", "hash", "check", *left)
    others = F.col("left_table") != F.col("table")
    # A share of the sample that is too small by SLACK rules a pair out; a whole column is its own sample.
    need = F.least("left_size", F.lit(sample)) * F.lit(max(0.0, min_containment - SLACK))
    likely = (
        values.join(F.broadcast(asked), ["kind", "hash", "check"])
        .filter(others)
        .groupBy("left_table", "left_column", "left_size", "table", "column")
        .agg(F.count("*").alias("hits"))
        .filter(F.col("hits") >= need)
        .select("left_table", "left_column", F.col("table").alias("right_table"), F.col("column").alias("right_column"))
    )
    mine = values.select("kind", "hash", "check", *left)
    theirs = values.select("kind", "hash", "check", F.col("table").alias("right_table"), F.col("column").alias("right_column"))
    found = (
        mine.join(F.broadcast(likely), ["left_table", "left_column"])
        .join(theirs, ["kind", "hash", "check", "right_table", "right_column"])
        .groupBy("left_table", "left_column", "right_table", "right_column", F.col("left_size").alias("left_values"))
        .agg(F.count("*").alias("shared_values"))
    )
    share = F.col("shared_values") / F.col("left_values")
    return found.filter(share >= min_containment).withColumn(
        "containment", ratio(F.col("shared_values"), F.col("left_values"))
    )


def links_in_database(spark: SparkSession, database: str, min_containment: float = 0.9, min_values: int = 20) -> DataFrame:
    """``discovered_links`` of all tables of a database."""
    names = [r["tableName"] for r in spark.sql(f"SHOW TABLES IN {database}").collect() if not r["isTemporary"]]
    return discovered_links({n: spark.table(f"{database}.{n}") for n in names}, min_containment, min_values)
