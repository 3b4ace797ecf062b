"""Writing tables and looking at the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_LISTING = "position int, column string, type string, nullable boolean"


def write_table(df: DataFrame, table: str, by_month: bool = False) -> None:
    """Create or overwrite ``table`` as Parquet from a different source.

    ``by_month`` adds ``event_month`` and partitions by it. The rebalance hint
    lets adaptive execution write a large month as several files of even size.
    """
    writer = df
    if by_month:
        month = F.date_format("timestamp", "yyyy-MM").alias("event_month")
        writer = df.select("*", month).hint("rebalance", "event_month")
    out = writer.write.mode("overwrite").format("parquet")
    (out.partitionBy("event_month") if by_month else out).saveAsTable(table)


def replace_table(df: DataFrame, table: str, by_month: bool = False) -> None:
    """Like ``write_table``, also where ``df`` reads ``table`` itself.

    The rows go to a staging table; the old table is renamed aside, the new one
    takes its name, and only then the old one is dropped. After a crash between
    these steps ``recover_table`` finishes or undoes the replacement; until then a
    left-over staging or old table is refused, as it may be the only copy.
    """
    spark = df.sparkSession
    staging, old = f"{table}__staging", f"{table}__old"
    if left := [t for t in (staging, old) if spark.catalog.tableExists(t)]:
        raise RuntimeError(f"{left[0]} is left of an earlier replacement: see recover_table")
    write_table(df, staging, by_month)
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    if by_month:
        # Some catalogs still list the partitions under the staging location.
        spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")


def recover_table(spark: SparkSession, table: str) -> None:
    """Undo a replacement that a crash cut short, or finish one that was complete."""
    staging, old = f"{table}__staging", f"{table}__old"
    if not spark.catalog.tableExists(table) and spark.catalog.tableExists(old):
        spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
    if spark.catalog.tableExists(table):
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        spark.sql(f"DROP TABLE IF EXISTS {staging}")


def list_tables(spark: SparkSession, database: str = "default") -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {database}")


def table_sizes(spark: SparkSession, database: str = "default") -> DataFrame:
    """One row per table of a database: its name, rows and columns. Rows are counted, from the footers
    of Parquet files where there are no other conditions."""
    names = [r["tableName"] for r in list_tables(spark, database).collect() if not r["isTemporary"]]
    if not names:
        return spark.createDataFrame([], "table_name string, row_count long, column_count int")
    parts = []
    for name in names:
        df = spark.table(f"{database}.{name}")
        parts.append(
            df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
            )
        )
    sizes = parts[0]
    for part in parts[1:]:
        sizes = sizes.unionByName(part)
    return sizes


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column of ``df``: position, name, type, how many values it has and their smallest and
    largest as text (by the column's own order); one pass, with partial aggregates only."""
    facts = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.count(F.col(f"`{f.name}`")).alias("value_count"),
            F.min(F.col(f"`{f.name}`")).cast("string").alias("smallest"),
            F.max(F.col(f"`{f.name}`")).cast("string").alias("largest"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def schema_listing(df: DataFrame) -> DataFrame:
    """One row per column of ``df``; reads no data."""
    fields = [
        (i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(fields, SCHEMA_LISTING)
