"""Reading CSV lines without losing or bending the damaged ones.

Spark's reader cuts surplus fields, pads missing ones and takes a quoted line break for two rows. Here a
file is read as lines, each is judged, and only sound lines are taken apart; the others are kept with their
file and what is wrong with them. Files stay splittable, and lines are read and judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE, FILE, REASON = "_line", "_file", "_reason"
#: Why a line is not taken.
OPEN_QUOTE, STRAY_QUOTE = "open quote", "stray quote"
SURPLUS, MISSING, UNREADABLE = "surplus fields", "missing fields", "not readable"

_FIELDS, _CORRUPT, _JUDGED = "_fields", "_corrupt", "_judged"
_QUOTED = "\u0001"


def _judged(line: Column, expected: int, escape: str) -> Column:
    """The reason not to take a line, NULL if it is sound.

    Escaped characters are taken out, then every quoted stretch becomes one mark. What is left has no
    quote, the mark is all of its field, and the commas are those between fields.
    """
    bare = F.translate(line, _QUOTED, " ")
    if escape != '"':
        bare = F.regexp_replace(bare, "\\" + escape + ".", "")
    bare = F.regexp_replace(bare, '"[^"]*+"', _QUOTED)

    def reason(bare: Column) -> Column:
        fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
        mixed = bare.rlike(f"[^,{_QUOTED}]{_QUOTED}|{_QUOTED}[^,{_QUOTED}]")
        return (
            F.when(F.contains(bare, F.lit('"')), OPEN_QUOTE)
            .when(mixed, STRAY_QUOTE)
            .when(fields > expected, SURPLUS)
            .when(fields < expected, MISSING)
        )

    # As the one element of an array what is left of the line is worked out once, not for every test.
    return F.get(F.transform(F.array(bare), reason), F.lit(0))


def _headers(names: list[str], escape: str) -> list[str]:
    """How the header line may be written: without quotes, with quotes where needed, all in quotes."""
    quoted = ['"' + n.replace('"', escape + '"') + '"' for n in names]
    needed = [q if any(c in n for c in ',"') else n for n, q in zip(names, quoted, strict=True)]
    return sorted({",".join(x) for x in (names, quoted, needed)})


def header_of(spark: SparkSession, path: str, escape: str = "\\") -> list[str]:
    """The column names in the first line; reads no more than that."""
    return spark.read.csv(path, header=True, escape=escape).columns


def read_lines(
    spark: SparkSession, path: str, columns: list[str] | None = None, escape: str = "\\", multi_line: bool = False
) -> DataFrame:
    """The lines of CSV files: ``columns`` as text (NULL in damaged lines), _line, _file and _reason.

    ``columns`` are the names in the header, which every file is to begin with; by default those of the
    first file. Headers and blank lines are left out. ``escape`` is the character before quotes inside
    quotes, a backslash, or a quote for doubled quotes. A record with line breaks inside its quotes is
    two or more lines with an open quote, none of which is taken; ``multi_line`` reads such records whole, at
    the price that a file is read by one task.
    """
    names = columns or header_of(spark, path, escape)
    types = ", ".join(f"`{n}` string" for n in [*names, _CORRUPT])
    options = {"escape": escape, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    if multi_line:
        reader = spark.read.schema(types).options(**options, multiLine=True, header=True, enforceSchema=True)
        read = reader.csv(path).select("*", F.col("_metadata.file_path").alias(FILE))
        raw = F.coalesce(_CORRUPT, F.to_csv(F.struct(*names)))
        parsed = read.select(F.struct(*names, _CORRUPT).alias(_FIELDS), raw.alias(LINE), FILE)
        reason = F.when(parsed[_FIELDS][_CORRUPT].isNotNull(), F.coalesce(_judged(F.col(LINE), len(names), escape), F.lit(UNREADABLE)))
    else:
        text = spark.read.text(path).select(
            F.regexp_replace("value", "^﻿|\r$", "").alias(LINE), F.col("_metadata.file_path").alias(FILE)
        )
        text = text.filter((F.trim(LINE) != "") & ~F.col(LINE).isin(_headers(names, escape)))
        text = text.withColumn(_JUDGED, _judged(F.col(LINE), len(names), escape))
        # Only sound lines are taken apart: the parser fails on one with very many fields.
        fields = F.from_csv(F.when(F.col(_JUDGED).isNull(), F.col(LINE)), types, options)
        parsed = text.select(fields.alias(_FIELDS), LINE, FILE, _JUDGED)
        reason = F.coalesce(_JUDGED, F.when(parsed[_FIELDS][_CORRUPT].isNotNull(), UNREADABLE))
    judged = parsed.withColumn(REASON, reason)
    sound = F.col(REASON).isNull()
    values = [F.when(sound, F.col(_FIELDS)[n]).alias(n) for n in names]
    return judged.select(*values, LINE, FILE, REASON)


def sound_rows(lines: DataFrame) -> DataFrame:
    """The columns of sound lines."""
    return lines.filter(F.col(REASON).isNull()).drop(LINE, FILE, REASON)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(file, reason, line) of the damaged lines."""
    return lines.filter(F.col(REASON).isNotNull()).select(
        F.col(FILE).alias("file"), F.col(REASON).alias("reason"), F.col(LINE).alias("line")
    )
