"""Exact de-duplication with a heavy-hitter split, in DataFrame functions only.

``approx_top_k`` keeps a Misra-Gries style frequent-items summary of the digests in every task and
merges them; whatever is frequent is among its items. The few candidates are then counted exactly,
and their verified winners (at most ``HEAVY`` rows) are broadcast: rows of a heavy digest are
decided where they are read. All other digests have few rows and take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txrisk.llm.frames import BLANKS, store

#: The most digests that are broadcast, and the items that a summary tracks.
HEAVY = 1000
#: Groups of tasks whose sketches are merged side by side before the last merge.
MERGE_GROUPS = 64
TRACKED = 16384


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


def digest(text: str = "text") -> Column:
    """SHA-256 of the text with every run of white space as one space; null counts as empty."""
    return F.sha2(normalised(text), 256)


def heavy_digests(digests: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """``digest`` of the rows that may be the most frequent; at most ``heavy`` rows."""
    # A sketch for each task, one for each group of tasks from these, and one of all from those.
    group = (F.spark_partition_id() % MERGE_GROUPS).alias("tasks")
    sketch, both = f"approx_top_k_accumulate(digest, {int(tracked)})", f"approx_top_k_combine(sketch, {int(tracked)})"
    some = digests.groupBy(group).agg(F.expr(sketch).alias("sketch"))
    merged = some.groupBy(F.lit("all")).agg(F.expr(both).alias("sketch"))  # no row of an empty table
    top = merged.select(F.expr(f"approx_top_k_estimate(sketch, {int(heavy)})").alias("top"))
    return top.select(F.explode("top").alias("top")).filter("top.count > 1").select(F.col("top.item").alias("digest"))


def _first(id_column: str) -> list[Column]:
    """Order of copies: by id, rows without an id last, equal ids by row number."""
    return [F.col(id_column).isNull(), F.col(id_column), F.col("_row")]


def decisions(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """For every row: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Exactly one row of each group is kept: the smallest id; of rows that repeat an id one of them;
    a row without an id only if no row of the group has one. An empty table gives no rows.
    Other columns of ``docs`` are not read, so their names do not matter.
    """
    # A stored row number tells rows apart that repeat an id; text is read once.
    keyed = store(
        docs.select(
            F.col(id_column), digest(text).alias("digest"), F.monotonically_increasing_id().alias("_row")
        ),
        "digests",
    )
    first = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_first(id_column))))
    winner = [F.min(first).alias("first"), F.count("*").alias("n")]
    verified = store(
        keyed.join(F.broadcast(heavy_digests(keyed, heavy, tracked)), "digest").groupBy("digest").agg(*winner),
        "heavy",
    )
    marked = keyed.join(F.broadcast(verified), "digest", "left")
    light = Window.partitionBy("digest")
    rest = (
        marked.filter("first IS NULL")
        .withColumn("first", F.min(first).over(light))
        .withColumn("n", F.count("*").over(light))
    )
    return (
        marked.filter("first IS NOT NULL")
        .unionByName(rest)
        .select(
            id_column,
            F.col("first.k1").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("first.k2") == F.col("_row")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def keep_first(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """``docs`` without copies, all its columns as they are.

    Rows of a heavy digest other than its winner go before the shuffle; one row of each digest
    is then taken, by id, whose partial limit also works before the shuffle. Which of several rows
    with one text *and* one id stays is open, that one stays is certain.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), digest(text).alias("digest"))
    keyed = keyed.withColumn("id", F.col(f"row.`{id_column}`"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))).alias("first")
    narrow = docs.select(digest(text).alias("digest"), F.col(id_column).alias("id"))
    digests = store(narrow, "digests")
    verified = store(
        digests.join(F.broadcast(heavy_digests(digests, heavy, tracked)), "digest").groupBy("digest").agg(first),
        "heavy",
    )
    left = keyed.join(F.broadcast(verified), "digest", "left").filter(
        F.col("first").isNull() | F.col("first.id").eqNullSafe(F.col("id"))
    )
    order = Window.partitionBy("digest").orderBy(F.col("id").isNull(), "id")
    best = left.withColumn("rank", F.row_number().over(order)).filter("rank = 1")
    return best.select(*(F.col(f"row.`{n}`").alias(n) for n in names))
