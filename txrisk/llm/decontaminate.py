"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Test items are short and documents long, so one signature length for both sides would lose items.
Items are therefore partitioned by the size of their shingle set, in powers of two. In a partition
with sets of at most ``u`` shingles, an item's sketch is its ``s = u - ceil(t * u) + 1`` smallest
MinHash values: a document that holds a share ``t`` of the item misses at most ``s - 1`` of its
shingles, so at least one value of the sketch is among the document's shingle hashes. Documents
with too few shingles for a partition are not probed against it. Every candidate is then verified
by exact containment of the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.frames import BLANKS, left_out, store

WIDTH = 5
CONTAINMENT = 75
#: Most sketch values that are compared with a document where it is read. Those of a larger benchmark
#: are joined to the documents' exploded hashes: broadcast up to the second number, beyond it shuffled.
PROBED_VALUES = 20_000
BROADCAST_ROWS = 200_000


def tokens(text: str) -> Column:
    """Lower-case words between white space; null counts as empty."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), BLANKS, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _runs(words: Column, width: int, of) -> Column:
    """``of`` each run of ``width`` words; a shorter text is one run as a whole."""

    def one(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))
        return F.transform(at, lambda i: of(w, i))

    # Bound to a variable, the words are split once and not for every run.
    return F.flatten(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), one))


def shingles(words: Column, width: int = WIDTH) -> Column:
    return F.array_distinct(_runs(words, width, lambda w, i: F.array_join(F.slice(w, i, width), " ")))


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of the runs, not distinct; words past the end hash as null."""
    return _runs(words, width, lambda w, i: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(width))))


def sketches(items: DataFrame, containment: int = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """Rows (item_id, size, part, need, value): the smallest hashes of each item's set."""
    sets = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), width))).alias("set"))
    size = F.size("set")
    part = F.floor(F.log2(size)).cast("int")
    most = (F.pow(F.lit(2.0), F.col("part") + 1) - 1).cast("int")
    missed = most - F.ceil(most * containment / 100)
    return (
        sets.filter(size > 0)
        .select("item_id", size.alias("size"), part.alias("part"), "set")
        .select(
            "item_id",
            "size",
            "part",
            F.ceil(F.col("size") * containment / 100).cast("int").alias("need"),
            F.explode(F.slice("set", 1, (missed + 1).cast("int"))).alias("value"),
        )
    )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    containment: int = CONTAINMENT,
    width: int = WIDTH,
    probed_values: int = PROBED_VALUES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_shingles) of documents that hold at least ``containment``
    percent of an item's distinct shingles, and ``row_key``, the document's hash of id and text.

    An item with fewer words than ``width`` is one shingle, found only in documents of just those
    words. Null and empty texts hold and match nothing. Rows that repeat id and text are one document.
    Item ids are taken as unique; rows that repeat an item's id and text count once.
    """
    items = store(
        benchmark.select("item_id", tokens("text").alias("words")).filter("size(words) > 0").distinct(), "items"
    )
    sketch = store(sketches(items, containment, width), "sketches")
    size = sketch.count()
    near = F.broadcast if size <= broadcast_rows else (lambda df: df)
    read = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    candidates = (_probed if size <= probed_values else _joined)(read, sketch, width, near)
    sets = items.select("item_id", shingles(F.col("words"), width).alias("wanted"))
    held = candidates.dropDuplicates(["row_key", "item_id"]).select(
        "doc_id", "row_key", "item_id", shingles(tokens("text"), width).alias("held")
    )
    shared = F.size(F.array_intersect("held", "wanted"))
    return (
        held.join(near(sets), "item_id")
        .select("doc_id", "item_id", shared.alias("n_shared"), F.size("wanted").alias("n_shingles"), "row_key")
        .filter(F.col("n_shared") * 100 >= F.col("n_shingles") * containment)
    )


def _probed(read: DataFrame, sketch: DataFrame, width: int, near) -> DataFrame:
    """Candidates (doc_id, row_key, text, item_id): few values, looked up among each document's hashes."""
    values = [str(r["value"]) for r in sketch.select("value").distinct().collect()]  # at most PROBED_VALUES
    if not values:
        return read.filter("false").withColumn("item_id", F.lit(None).cast(sketch.schema["item_id"].dataType))
    wanted = F.split(F.lit(",".join(values)), ",").cast("array<bigint>")
    return (
        read.withColumn("values", shingle_hashes(tokens("text"), width))
        .select("doc_id", "row_key", "text", F.size("values").alias("n"), F.array_intersect(wanted, "values").alias("hits"))
        .filter("size(hits) > 0")
        .select("doc_id", "row_key", "text", "n", F.explode("hits").alias("value"))
        .join(near(sketch), "value")
        .filter("n >= need")
        .select("doc_id", "row_key", "text", "item_id")
    )


def _joined(read: DataFrame, sketch: DataFrame, width: int, near) -> DataFrame:
    """The same by exploded hashes: only candidates' keys are shuffled, then joined to their texts."""
    pairs = (
        read.withColumn("values", shingle_hashes(tokens("text"), width))
        .select("row_key", F.size("values").alias("n"), F.explode("values").alias("value"))
        .join(near(sketch), "value")
        .filter("n >= need")
        .select("row_key", "item_id")
        .distinct()
    )
    return read.join(store(pairs, "candidates"), "row_key").select("doc_id", "row_key", "text", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: int = CONTAINMENT) -> DataFrame:
    """``docs`` without the documents that hold a test item; its columns as they are. Items are told
    apart by their words, so those without an id count too."""
    items = benchmark.select(F.xxhash64(tokens("text")).alias("item_id"), "text")
    found = leaks(docs, items, containment).select("doc_id", "row_key").distinct()
    return left_out(docs, store(found, "leaked"), F.col("doc_id"), F.xxhash64("doc_id", "text"))
