"""Reading transactions and the data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txrisk.sources import lines
from txrisk.sources.staging import new_path


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "csv", infer: bool = False
) -> DataFrame:
    """Raw transactions from CSV with a header, Parquet, or a catalog table.

    CSV columns come as text, so that ``prepare`` sees bad values instead of
    NULLs and the file is read once. Damaged lines are left out, never cut or
    padded; ``lines.rejected_lines`` has them. ``infer=True`` writes the sound
    lines to the shared folder and reads them twice to guess types.
    """
    if fmt == "csv":
        found = lines.read_lines(spark, path)
        return _inferred(found) if infer else lines.sound_rows(found)
    if fmt == "table":
        return spark.table(path)
    return spark.read.format(fmt).load(path)


def _inferred(found: DataFrame) -> DataFrame:
    rows = lines.sound_rows(found)
    folder = new_path(rows.sparkSession, "sound")
    rows.write.csv(folder, header=True)
    return rows.sparkSession.read.csv(folder, header=True, inferSchema=True)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The data dictionary: a small CSV with a header and columns of its own."""
    return spark.read.csv(path, header=True, inferSchema=True)
