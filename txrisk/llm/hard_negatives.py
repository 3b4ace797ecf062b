"""Hard negatives by the threshold algorithm.

Scores are inner products of whole numbers. Candidates are packed in blocks; a block has a list of its
rows for every dimension, sorted by that entry. For an anchor the lists are read from the end that its
sign in the dimension prefers, all to the same depth, and each row that turns up is scored. No row that
has not turned up can score more than the anchor does with the last entries read, which is the threshold.
Reading stops once that is strictly below the k-th best score found (strictly: ties go by id), or below
the lowest score that a window admits.

This is done twice. First each anchor's best rows of its own label are found, its positives. Each
positive sets a window of scores, and the best rows of other labels within every window are the hard
negatives. Anchors are packed in groups; a group meets the blocks in several tasks, each of which holds the
group and some blocks, and gives out at most k rows for an anchor, window and block. The best of those
are chosen by a window function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txrisk.llm.frames import store
from txrisk.llm.vectors import matrix, scaled, usable

FACTOR = 256
POSITIVES = NEGATIVES = 5
#: A negative's score is between these percentages of its positive's.
LOWEST, HIGHEST = 80, 100
#: Rows of a block of candidates, of a group of anchors, and blocks that one task holds on average.
BLOCK_ROWS, GROUP_ROWS, BLOCKS_AT_ONCE = 4096, 2048, 8
#: Groups with their blocks that one task works on, one after another, where there are very many.
GRIDS_AT_ONCE = 4
#: Depth of the first read of the lists; it doubles from read to read.
FIRST_DEPTH = 32

BLOCK = "pack long, n long, ids binary, labels binary, vectors binary"
GROUP = BLOCK + ", anchors binary, counts binary, lows binary, highs binary"
FOUND = "anchor long, anchor_id long, window int, candidate_id long, score long"
#: A window of all scores.
ANY = (-(1 << 62), 1 << 62)


def prepared(vectors: DataFrame, label: Column, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(vec_id, label, x) of the rows that take part: with an id, a label and a usable vector."""
    return vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.when(usable(vector), scaled(vectors, vector, FACTOR)).alias("x"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")


def _bytes(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three types, named by the first byte."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    size = next(k for k in (2, 4, 8) if -(1 << 8 * k - 1) <= low and high < 1 << 8 * k - 1)
    return b"%d" % size + zstandard.compress(np.ascontiguousarray(values.astype(f"<i{size}")).tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), f"<i{data[:1].decode()}").astype(np.int64)


def _packs(rows: DataFrame, most: int, write, schema: str) -> DataFrame:
    """``rows`` as packs of at most ``most`` rows: a number, and what ``write`` makes of a batch of them."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        where, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def give_out():
            table = pa.Table.from_batches(held).combine_chunks()
            values = [where + made, table.num_rows, *write(table)]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (len(values) - 2)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        for b in batches:
            while b.num_rows:
                part = b.slice(0, most - size)
                b = b.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == most:
                    yield give_out()
                    held, size, made = [], 0, made + 1
        if held:
            yield give_out()

    return rows.mapInArrow(run, schema)


def _write_rows(table: pa.Table) -> list[bytes]:
    return [
        _bytes(table.column("vec_id").to_numpy()),
        _bytes(table.column("label").to_numpy()),
        _bytes(matrix(table.column("x").chunk(0))),
    ]


def _write_anchors(table: pa.Table) -> list[bytes]:
    """Rows with the anchors' numbers and their windows, one after another."""
    windows = table.column("windows").to_pylist()
    flat = np.array([w for ws in windows for w in ws], np.int64).reshape(-1, 2)
    counts = np.array([len(ws) for ws in windows], np.int64)
    more = [table.column("anchor").to_numpy(), counts, flat[:, 0], flat[:, 1]]
    return [*_write_rows(table), *map(_bytes, more)]


def blocks_of(rows: DataFrame) -> DataFrame:
    """Candidates (vec_id, label, x) in stored blocks."""
    return store(_packs(rows.select("vec_id", "label", "x"), BLOCK_ROWS, _write_rows, BLOCK), "blocks")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _numbers(row["ids"]), _numbers(row["labels"]), _numbers(row["vectors"]).reshape(row["n"], -1)


class Block:
    """A block of candidates with its sorted lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        by_id = np.argsort(ids, kind="stable")  # among equal scores the smaller id comes first
        self.ids, self.labels, self.x = ids[by_id], labels[by_id], x[by_id]
        self.order = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)
        self.entries = np.take_along_axis(self.x, self.order, axis=0)
        self.largest = int(np.abs(self.x).max(initial=0))
        self.real = self.x.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; doubles are exact as long as no sum leaves 53 bits."""
        bound = self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor)
        if bound < 1 << 53:
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)
        if bound < 1 << 62:
            return self.x[rows] @ anchor
        raise ValueError("entries are too large for scores in 64 bits")

    def reads(self, anchor: np.ndarray):
        """Sorted access: (rows that are new, highest score of the rows not yet read; None at the end)."""
        used = np.flatnonzero(anchor)
        down = anchor[used] > 0
        weights = [int(w) for w in anchor[used]]
        seen = np.zeros(len(self.ids), bool)
        size, depth, step = len(self.ids), 0, FIRST_DEPTH
        while depth < size and len(used):
            places = np.arange(depth, min(depth + step, size))[:, None]
            depth, step = depth + len(places), step * 2
            rows = np.zeros(size, bool)
            rows[self.order[np.where(down, size - 1 - places, places), used].ravel()] = True
            new = np.flatnonzero(rows & ~seen)
            seen |= rows
            if depth >= size or seen.all():
                yield new, None
                return
            last = self.entries[np.where(down, size - depth, depth - 1), used]
            yield new, sum(w * int(e) for w, e in zip(weights, last, strict=True))
        yield np.arange(size), None  # all scores are 0

    def best(
        self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], most: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (lowest, highest score) the best ``most`` allowed rows and their scores."""
        rows = scores = np.zeros(0, np.int64)
        found = []
        for new, threshold in self.reads(anchor):
            new = new[allowed[new]]
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.scores(new, anchor)])
            found = [_top(rows, scores, low, high, most) for low, high in windows]
            if threshold is not None and all(
                threshold < low or (len(s) == most and threshold < s[-1])
                for (low, _), (_, s) in zip(windows, found, strict=True)
            ):
                break
        return found


def _top(rows: np.ndarray, scores: np.ndarray, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``most`` rows within a window, best first, smaller rows first among equals."""
    inside = np.flatnonzero((scores >= low) & (scores <= high))
    if len(inside) > most:
        kth = np.partition(scores[inside], len(inside) - most)[len(inside) - most]
        inside = inside[scores[inside] >= kth]
    inside = inside[np.lexsort((rows[inside], -scores[inside]))[:most]]
    return rows[inside], scores[inside]


def _in_blocks(theirs: pa.Table, ours: pa.Table, most: int, own_label: bool) -> list[tuple]:
    """Rows of FOUND for all anchors of some groups in some blocks."""
    out: list[tuple] = []
    groups = ours.to_pylist()
    for row in theirs.to_pylist():
        block = Block(*_unpacked(row))
        for group in groups:
            ids, labels, x = _unpacked(group)
            numbers, counts, lows, highs = (_numbers(group[c]) for c in ("anchors", "counts", "lows", "highs"))
            ends = np.cumsum(counts)
            for k in range(len(ids)):
                of = slice(ends[k] - counts[k], ends[k])
                windows = list(zip(lows[of].tolist(), highs[of].tolist(), strict=True))
                same = block.labels == labels[k]
                allowed = same & (block.ids != ids[k]) if own_label else ~same
                if not windows or not allowed.any():
                    continue
                for w, (r, s) in enumerate(block.best(x[k], allowed, windows, most)):
                    at = int(numbers[k]), int(ids[k]), w
                    out.extend((*at, i, a) for i, a in zip(block.ids[r].tolist(), s.tolist(), strict=True))
    return out


def search(blocks: DataFrame, anchors: DataFrame, most: int, own_label: bool) -> DataFrame:
    """(anchor, anchor_id, window, rank, candidate_id, score): per anchor and window its best rows.

    ``anchors`` has (anchor, vec_id, label, x, windows); ``own_label`` says whether rows of the anchor's
    label count, without those of its id, or those of other labels.
    """
    spark = blocks.sparkSession
    asking = anchors.select("vec_id", "label", "x", "anchor", "windows")
    groups = store(_packs(asking, GROUP_ROWS, _write_anchors, GROUP), "groups")
    n_blocks, parts = blocks.count(), max(1, groups.count())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, min(n_blocks, max(-(-n_blocks // BLOCKS_AT_ONCE), -(-tasks // parts))))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("pack"), F.lit(n)).cast("int")

    # The work grows with pairs, not bytes, so the number of tasks is set and not left to the bytes.
    number, at = max(tasks, parts * slots // GRIDS_AT_ONCE), ["part", "slot"]
    sent = blocks.withColumn("slot", dealt(slots)).withColumn("part", every(parts)).repartition(number, *at)
    asked = groups.withColumn("part", dealt(parts)).withColumn("slot", every(slots)).repartition(number, *at)
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(theirs: pa.Table, ours: pa.Table) -> pa.Table:
        rows = _in_blocks(theirs, ours, most, own_label) if theirs.num_rows and ours.num_rows else []
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    found = sent.groupBy("part", "slot").cogroup(asked.groupBy("part", "slot")).applyInArrow(run, FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "candidate_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("anchor", "anchor_id", "window", "rank", "candidate_id", "score")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``prepared`` rows.

    An anchor's positives are its best ``positives`` rows of the same label and another id; a positive's
    negatives the best ``negatives`` rows of other labels that score from ``lowest`` to ``highest`` percent
    of it. Equal scores go by the smaller id. Rows of one id are candidates each; anchors of one id have
    results each. An anchor without positives, and a positive without negatives, have no rows; an empty
    table gives none. A positive of a negative score has an empty window, as 80 percent of it is more.
    """
    rows = store(rows.select("vec_id", "label", "x"), "rows")
    blocks = blocks_of(rows)
    anchors = store(rows.filter(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    any_score = F.array(F.array(*[F.lit(v).cast("long") for v in ANY]))
    near = store(search(blocks, anchors.withColumn("windows", any_score), positives, True), "positives")
    # At least ``lowest`` percent, rounded up, as scores are whole numbers.
    score = F.col("score").cast("decimal(20,0)")
    low, high = F.ceil(score * lowest / 100).cast("long"), F.floor(score * highest / 100).cast("long")
    order = Window.partitionBy("anchor").orderBy("rank")
    windows = (
        near.withColumns({"low": low, "high": high})
        .filter("low <= high")
        .select(
            "anchor",
            (F.row_number().over(order) - 1).alias("window"),
            F.col("candidate_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
            "low",
            "high",
        )
    )
    listed = F.array_sort(F.collect_list(F.struct("window", "low", "high")))  # at most ``positives`` of them
    per_anchor = windows.groupBy("anchor").agg(F.transform(listed, lambda w: F.array(w["low"], w["high"])).alias("windows"))
    found = search(blocks, anchors.join(per_anchor, "anchor"), negatives, False)
    return found.join(windows, ["anchor", "window"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("candidate_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
