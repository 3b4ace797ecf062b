"""From a raw file to the two stored tables that investigators query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.operators.prepare import bad_columns, cast_to_schema, counts_of_bad, dedup_audit, dedup_by_id
from txrisk.plans.scoring import score
from txrisk.sources.lines import FILE, LINE, REASON, read_lines, rejected_lines
from txrisk.sources.readers import read_transactions
from txrisk.sources.staging import stage
from txrisk.sources.tables import replace_table
from txrisk.spec import RiskSpec, SkewPolicy

BAD = "_bad_columns"


def build_transactions(
    spark: SparkSession,
    path: str,
    table: str = "transactions",
    fmt: str = "csv",
    lenient: bool = False,
    by_month: bool = False,
    null_ids: str = "keep",
    nan_to_null: bool = False,
    damaged: str | None = None,
) -> DataFrame:
    """Read, type, de-duplicate and store the transactions.

    What was removed is stored as ``<table>_rejects``, and how many values of each
    column did not fit its type as ``<table>_reject_counts``. Damaged lines of a CSV
    file are stored as the table ``damaged``; without that name they fail the build.
    Text is read and parsed once: the typed rows are staged with the names of their
    bad columns, beside the damaged lines, and rows without an id are found by the
    statistics of the staged files.
    """
    if fmt == "csv":
        found = read_lines(spark, path)
        raw = found.drop(LINE, FILE, REASON)
        of_line = [F.when(F.col(REASON).isNotNull(), F.col(c)).alias(c) for c in (LINE, FILE)] + [F.col(REASON)]
    else:
        found = raw = read_transactions(spark, path, fmt)
        of_line = []
    marked = found.withColumn(BAD, bad_columns(found))
    cast = cast_to_schema(marked, lenient=lenient, nan_to_null=nan_to_null)
    staged = stage(cast.select(*raw.columns, BAD, *of_line), "typed")
    rows = staged
    if of_line:
        lines = rejected_lines(staged)
        if damaged:
            replace_table(lines, damaged)
        elif first := lines.first():
            raise ValueError(f"damaged line ({first['reason']}) in {first['file']}: {first['line'][:200]}")
        rows = staged.filter(F.col(REASON).isNull()).drop(LINE, FILE, REASON)
    typed = rows.drop(BAD)
    replace_table(dedup_audit(typed), f"{table}_rejects")
    replace_table(counts_of_bad(rows, BAD), f"{table}_reject_counts")
    replace_table(dedup_by_id(typed, null_ids), table, by_month)
    return spark.table(table)


def build_scored(
    spark: SparkSession,
    source: str = "transactions",
    table: str = "scored_transactions",
    spec: RiskSpec = RiskSpec(),
    by_month: bool = False,
    policy: SkewPolicy | None = SkewPolicy(),
    exact: bool = False,
) -> DataFrame:
    """Score the stored transactions and store the result."""
    replace_table(score(spark.table(source), spec, policy=policy, exact=exact), table, by_month)
    return spark.table(table)
