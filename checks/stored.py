"""Queries over files and catalog tables that the library has written itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import queries as base
from txrisk.fixtures import transactions
from txrisk.operators import prepare
from txrisk.plans import lookup
from txrisk.plans.refresh import publish_scored, rescore
from txrisk.plans.tables import build_scored, build_transactions
from txrisk.schema import TRANSACTION_COLUMNS
from txrisk.sources.clustered import write_clustered
from txrisk.sources.lines import read_lines, rejected_lines, sound_rows
from txrisk.sources.readers import read_dictionary, read_transactions
from txrisk.sources.staging import new_path, shared_folder, stage
from txrisk.sources.tables import column_facts, list_tables, replace_table, schema_listing, table_sizes

_csv: dict[tuple[str, ...], str] = {}
_databases: dict[tuple[str, str, str], str] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir


def csv_file(spark: SparkSession, sf_dir: str) -> str:
    """The postings as CSV, written once per session and scale."""
    key = _key(spark, sf_dir)
    if key not in _csv:
        path = f"{shared_folder(spark)}/{key[0]}/postings-{uuid.uuid4().hex}"
        base.postings(spark, sf_dir).write.csv(path, header=True)
        _csv[key] = path
    return _csv[key]


#: What the country field becomes, and what comes behind a line, by the remainder of the order's number.
DAMAGED_COUNTRY = {3: '"{}', 4: '"{}\nx"', 5: '{}"b"'}
DAMAGED_END = {1: ",extra"}


def damaged_file(spark: SparkSession, sf_dir: str) -> str:
    """The postings as lines of text with a header, some with surplus or missing fields, open or stray
    quotes, or a line break within quotes; written once per session and scale."""
    key = (*_key(spark, sf_dir), "damaged")
    if key not in _csv:
        rows = base.postings(spark, sf_dir)
        fault = F.col("transaction_id").cast("long") % 40
        country, end = F.col("country"), F.lit("")
        for k, form in DAMAGED_COUNTRY.items():
            country = F.when(fault == k, F.format_string(form.replace("{}", "%s"), "country")).otherwise(country)
        for k, more in DAMAGED_END.items():
            end = F.when(fault == k, more).otherwise(end)
        first = [F.coalesce(country if c == "country" else c, F.lit("")) for c in TRANSACTION_COLUMNS[:-1]]
        last = F.when(fault == 2, "").otherwise(F.concat(F.lit(","), F.coalesce(TRANSACTION_COLUMNS[-1], F.lit(""))))
        text = rows.select(F.concat(F.concat_ws(",", *first), last, end).alias("value"))
        header = spark.createDataFrame([(",".join(TRANSACTION_COLUMNS),)], "value string")
        path = new_path(spark, "damaged")
        header.unionByName(text).write.text(path)
        _csv[key] = path
    return _csv[key]


def database(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A database of its own for the tables of one kind: made once per session and scale."""
    key = (*_key(spark, sf_dir), kind)
    if key not in _databases:
        name = f"{kind}_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {name}")
        if kind == "payments":
            build_transactions(spark, csv_file(spark, sf_dir), f"{name}.payments", lenient=True)
        else:
            replace_table(transactions(spark, sf_dir), f"{name}.transactions")
            build_scored(spark, f"{name}.transactions", f"{name}.scored", exact=True)
        _databases[key] = name
    return _databases[key]


def csv_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.cast_to_schema(read_transactions(spark, csv_file(spark, sf_dir)), lenient=True)


def csv_sound_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_lines(spark, damaged_file(spark, sf_dir), TRANSACTION_COLUMNS)
    return prepare.cast_to_schema(sound_rows(found), lenient=True)


def csv_rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_lines(spark, damaged_file(spark, sf_dir), TRANSACTION_COLUMNS)
    return rejected_lines(found).select("reason", "line")


def stored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{database(spark, sf_dir, 'payments')}.payments"
    return read_transactions(spark, name, fmt="table").select(TRANSACTION_COLUMNS)


def stored_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(f"{database(spark, sf_dir, 'payments')}.payments_rejects")


def stored_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(f"{database(spark, sf_dir, 'payments')}.payments_reject_counts")


def stored_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(f"{database(spark, sf_dir, 'scored')}.scored")


#: Users that are looked up by name, and the day whose rows and all later ones arrive afterwards.
NAMED_USERS = [0, 1, 2, 3, 17, 30]
ARRIVALS = "2024-01-25"


def clustered(spark: SparkSession, sf_dir: str) -> str:
    """The scored table as ``write_clustered`` writes it, once per session and scale."""
    key = (*_key(spark, sf_dir), "clustered")
    if key not in _databases:
        name = f"clustered_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {name}")
        write_clustered(base.scored(spark, sf_dir), f"{name}.scored")
        _databases[key] = name
    return f"{_databases[key]}.scored"


def timeline_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.timeline_of_users(spark, clustered(spark, sf_dir), NAMED_USERS)


def profile_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.profile_of_users(spark, clustered(spark, sf_dir), NAMED_USERS)


def worst_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.worst_of_users(spark, clustered(spark, sf_dir), NAMED_USERS)


def rescored_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table of the earlier rows, after the later ones have arrived."""
    tx = transactions(spark, sf_dir)
    later = F.col("timestamp") >= F.lit(ARRIVALS).cast("timestamp")
    name = f"default.rescored_{uuid.uuid4().hex}"
    publish_scored(tx.filter(~later), name, exact=True)
    return rescore(spark, name, tx.filter(later))


def schema_of_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_listing(stored_transactions(spark, sf_dir))


def table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_tables(spark, database(spark, sf_dir, "payments")).selectExpr("tableName AS table_name")


def table_sizes_of_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_sizes(spark, database(spark, sf_dir, "payments"))


def column_facts_of_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = stored_transactions(spark, sf_dir).drop("timestamp", "amount")
    return column_facts(whole)


def dictionary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of parts as a dictionary file, read again."""
    key = (*_key(spark, sf_dir), "dictionary")
    if key not in _csv:
        parts = spark.read.parquet(f"{sf_dir}/part.parquet")
        path = new_path(spark, "dictionary")
        names = F.col("p_partkey").alias("column"), F.concat_ws(", ", "p_name", "p_type").alias("description")
        parts.select(*names).write.csv(path, header=True)
        _csv[key] = path
    return read_dictionary(spark, _csv[key])


def staged_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(transactions(spark, sf_dir), "transactions")


STORED = {
    "csv_transactions": csv_transactions,
    "csv_sound_transactions": csv_sound_transactions,
    "csv_rejected_lines": csv_rejected_lines,
    "stored_transactions": stored_transactions,
    "stored_rejects": stored_rejects,
    "stored_reject_counts": stored_reject_counts,
    "stored_scored": stored_scored,
    "timeline_of_users": timeline_of_users,
    "profile_of_users": profile_of_users,
    "worst_of_users": worst_of_users,
    "rescored_after_append": rescored_after_append,
    "table_sizes": table_sizes_of_payments,
    "column_facts": column_facts_of_stored,
    "dictionary_rows": dictionary_rows,
    "staged_transactions": staged_transactions,
    "schema_listing": schema_of_stored,
    "table_listing": table_listing,
}
