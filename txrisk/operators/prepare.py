"""Typing raw transactions and removing duplicate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators.skew import split_hot
from txrisk.schema import TRANSACTIONS
from txrisk.spec import SkewPolicy

ID = "transaction_id"
BOOLEAN_WORDS = {"true": "1", "false": "0"}
DECIMAL_TEXT = T.DecimalType(38, 6)  # whole numbers may be written as 12.0
#: A number as text: the digits before the point, those after it, the exponent.
NUMBER = r"^[\x00-\x20]*[+-]?([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?[\x00-\x20]*$"
#: Texts that Spark's own cast takes for the same whole number, of so few digits that they fit the type.
PLAIN = r"\A[+-]?[0-9]{1,%d}\z"
PLAIN_DIGITS = {T.ByteType: 2, T.ShortType: 4, T.IntegerType: 9, T.LongType: 18}
FRACTION = r"^[\x00-\x20]*[+-]?[0-9]*\.0*[1-9][0-9]*[\x00-\x20]*$"


def _typed(df: DataFrame, field: T.StructField, lenient: bool) -> Column:
    column, have = F.col(field.name), df.schema[field.name].dataType
    if have == field.dataType:
        return column
    steps = [field.dataType]
    whole = isinstance(field.dataType, T.IntegralType)
    if whole and isinstance(have, T.StringType | T.FractionalType):
        steps.insert(0, DECIMAL_TEXT)
        # Before the decimal cast, which rounds.
        fraction = _has_fraction(column) if isinstance(have, T.StringType) else column % 1 != 0
        refused = None if lenient else _not_whole(column, field.name)
        column = F.when(fraction, refused).otherwise(column)
    for step in steps:
        column = column.try_cast(step) if lenient else column.cast(step)
    if whole and isinstance(have, T.StringType):
        column = _quickly(F.col(field.name), field.dataType, column, lenient)
    return column


def _quickly(text: Column, kind: T.DataType, other: Column, lenient: bool) -> Column:
    """``other`` for the few texts that need it: decimals are slow, and slowest where a text is no number."""
    value = F.when(text.rlike(PLAIN % PLAIN_DIGITS[type(kind)]), text.try_cast(kind))
    word = F.lower(F.trim(text))
    for name, number in BOOLEAN_WORDS.items():
        value = value.when(word == name, F.lit(number).cast(kind))
    # Without a digit of any script it is no number; a strict cast says so itself.
    return value.when(text.rlike(r"\p{Nd}"), other) if lenient else value.otherwise(other)


def _not_whole(number: Column, name: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{name} is not a whole number: "), number.cast("string")))


def _has_fraction(text: Column) -> Column:
    """Whether a number written as text has digits other than 0 after its point, however many there are.
    What is no number is left to the cast."""
    before, after, power = (F.regexp_extract(text, NUMBER, k) for k in (1, 2, 3))
    moved = F.coalesce(power.try_cast("int"), F.lit(0))
    behind = F.when(moved >= 0, F.substr(after, moved + 1)).otherwise(F.concat(F.right(before, -moved), after))
    return F.when(text.rlike("[0-9.][eE]"), behind.rlike("[^0]")).otherwise(text.rlike(FRACTION))


def cast_to_schema(
    df: DataFrame,
    schema: T.StructType = TRANSACTIONS,
    lenient: bool = False,
    nan_to_null: bool = False,
) -> DataFrame:
    """``df`` with the schema's types; further columns stay as they are.

    A missing column is an error. A value that does not fit its type, a fraction
    for a whole number too, fails the query, or turns NULL when ``lenient`` (see
    ``reject_counts``).
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    known = {f.name: f for f in schema}
    columns = []
    for name in df.columns:
        value = _typed(df, known[name], lenient) if name in known else F.col(name)
        if nan_to_null and name in known and isinstance(known[name].dataType, T.DoubleType):
            value = F.when(~F.isnan(value), value)
        columns.append(value.alias(name))
    return df.select(columns)


def bad_columns(df: DataFrame, schema: T.StructType = TRANSACTIONS) -> Column:
    """Names of the columns of a row whose values do not fit the schema."""
    present = [f for f in schema if f.name in df.columns]
    bad = [
        F.when(F.col(f.name).isNotNull() & _typed(df, f, lenient=True).isNull(), f.name)
        for f in present
    ]
    return F.array_compact(F.array(*bad))


def counts_of_bad(df: DataFrame, column: str, schema: T.StructType = TRANSACTIONS) -> DataFrame:
    """What ``reject_counts`` gives, from rows that have their ``bad_columns`` in ``column``."""
    names = [f.name for f in schema if f.name in df.columns]
    counts = df.agg(*[F.count_if(F.array_contains(column, n)).alias(n) for n in names])
    return counts.unpivot([], names, "column", "rejected")


def reject_counts(df: DataFrame, schema: T.StructType = TRANSACTIONS) -> DataFrame:
    """Per column, how many non-NULL values do not fit the schema; one pass."""
    present = [f for f in schema if f.name in df.columns]
    counts = df.agg(
        *[
            F.count_if(F.col(f.name).isNotNull() & _typed(df, f, lenient=True).isNull()).alias(f.name)
            for f in present
        ]
    )
    return counts.unpivot([], [f.name for f in present], "column", "rejected")


def _order(df: DataFrame) -> list[str]:
    """A total order of a table's rows: by time, then by every other column."""
    return sorted((c for c in df.columns if c != ID), key=lambda c: c != "timestamp")


def dedup_by_id(df: DataFrame, null_ids: str = "keep") -> DataFrame:
    """One row per transaction id: the first by time, then by the other columns.

    Each task keeps only the best row of an id before the shuffle, so an id with
    any number of copies is no hot spot. Rows without an id are all kept, or
    collapsed to one with ``null_ids="collapse"``.
    """
    first = F.row_number().over(Window.partitionBy(ID).orderBy(*_order(df)))
    if null_ids == "collapse":
        return df.withColumn("_rn", first).filter("_rn = 1").drop("_rn")
    known = df.filter(F.col(ID).isNotNull())
    kept = known.withColumn("_rn", first).filter("_rn = 1").drop("_rn")
    return kept.unionByName(df.filter(F.col(ID).isNull()))


def dedup_audit(df: DataFrame, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """What ``dedup_by_id`` removes: each distinct rejected content with its number
    of removed copies, and whether it conflicts with the row that is kept.

    Rows are shuffled once, by their id; only ids that are hot by ``policy`` are not, see ``_audit_of_hot``."""
    ordinary, hot = split_hot(df.filter(F.col(ID).isNotNull()), ID, policy)
    columns = df.columns
    own = Window.partitionBy(ID).orderBy(*_order(df))
    kept = F.first(F.struct(*columns)).over(own)
    removed = (
        ordinary.withColumns({"_kept": kept, "_rn": F.row_number().over(own)})
        .filter("_rn > 1")
        .select(*columns, (~F.struct(*columns).eqNullSafe(F.col("_kept"))).alias("_conflict"))
    )
    audit = removed.groupBy(*columns).agg(
        F.count("*").alias("removed_copies"), F.bool_or("_conflict").alias("is_conflict")
    )
    return audit.unionByName(_audit_of_hot(hot))


def _audit_of_hot(df: DataFrame) -> DataFrame:
    """``dedup_audit`` of ids with any number of rows: no task gets all the rows of one."""
    columns = df.columns
    contents = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
    # An id with many contents cannot all go to one window: the kept content is
    # found with map-side reduction and the contents are compared by a join.
    first = F.row_number().over(Window.partitionBy(ID).orderBy(*_order(df)))
    kept = (
        contents.withColumn("_rn", first)
        .filter("_rn = 1")
        .select(F.col(ID).alias("_id"), F.struct(*columns).alias("_kept"))
    )
    same = F.struct(*columns).eqNullSafe(F.col("_kept"))
    return (
        contents.join(kept, F.col(ID) == F.col("_id"))
        .select(
            *columns,
            F.when(same, F.col("_copies") - 1).otherwise(F.col("_copies")).alias("removed_copies"),
            (~same).alias("is_conflict"),
        )
        .filter("removed_copies > 0")
    )


def prepare(
    df: DataFrame, lenient: bool = False, null_ids: str = "keep", nan_to_null: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(prepared, audit)``: typed rows with unique ids, and what was removed.

    Both are lazy and neither changes ``df``.
    """
    typed = cast_to_schema(df, lenient=lenient, nan_to_null=nan_to_null)
    return dedup_by_id(typed, null_ids), dedup_audit(typed)
