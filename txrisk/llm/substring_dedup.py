"""Substring de-duplication behind a count-min prefilter.

Pass 1: every task counts its windows in a sparse count-min sketch (two rows of cells, counts up to
two); the sketches are merged block by block, and cells of two and more become one bit each. A
window's count is never underestimated, so a window with a clear bit occurs once.
Pass 2: only windows estimated repeated go on. Documents are dealt into chunks; a chunk decides the
windows it holds in several documents itself and sends one document of each window to a bucket, where
windows are grouped exactly (hashes of 64 and 16 bits beside the bucket number) and the smallest
document id found. Word positions to remove come back to the chunk and are cut out of the texts.

Beyond what the cells can tell apart the sketch passes more windows on; the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.frames import (
    PACKED,
    buckets,
    chunks,
    documents_of,
    pack,
    pack_sorted,
    packed_rows,
    unpack,
    unpack_sorted,
)
from txrisk.llm.words import SECOND, runs, starts_of_runs, word_hashes

WIDTH = 13
#: log2 of the cells in a row of the sketch. Two rows of bits are broadcast: 2 * 2**28 / 8 bytes = 64 MB.
CELL_BITS = 28
BLOCK_BITS = 20
#: Windows a task counts before it gives out a sketch and starts another.
WINDOWS_IN_SKETCH = 4_000_000
#: Bytes of text that are split into words at a time.
SLICE_BYTES = 4 << 20

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _windows(texts: list[bytes], width: int):
    """Words of each text; two hashes, position and text of every window."""
    words = [t.split() for t in texts]
    hashes, sizes = word_hashes(words)
    at, owner = starts_of_runs(sizes, width)
    return words, sizes, runs(hashes, width)[at], runs(hashes, width, SECOND)[at], at, owner


def _cells(first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return (first >> shift).astype(np.uint32), (second >> shift).astype(np.uint32)


def _sketch_rows(row: int, cells: np.ndarray, block_bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(row, block, cells with a count, cells with two or more), packed."""
    found, counts = np.unique(cells, return_counts=True)
    many = found[counts > 1]
    edges = np.arange((int(found[-1]) >> block_bits) + 2, dtype=np.int64) << block_bits
    cut, cut_many = np.searchsorted(found, edges), np.searchsorted(many, edges)
    for block in np.flatnonzero(np.diff(cut)).tolist():
        base = block << block_bits
        one, two = found[cut[block] : cut[block + 1]], many[cut_many[block] : cut_many[block + 1]]
        yield row, block, pack_sorted(one.astype(np.int64) - base), pack_sorted(two.astype(np.int64) - base)


def _slices(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for value in column:
        if text := value.as_py():
            held.append(text)
            size += len(text)
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def repeated_cells(docs: DataFrame, width: int, cell_bits: int, text: str = "text") -> list[np.ndarray]:
    """The merged sketch as two rows of bits: cells that count at least two windows."""
    block_bits = min(BLOCK_BITS, cell_bits)

    def count(batches):
        held: list[list[np.ndarray]] = [[], []]

        def give_out():
            rows = [x for row in (0, 1) if held[row] for x in _sketch_rows(row, np.concatenate(held[row]), block_bits)]
            held[0].clear(), held[1].clear()
            for k in range(0, len(rows), 64):
                part = list(zip(*rows[k : k + 64], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2]), pa.array(part[3])],
                    ["row", "block", "one", "two"],
                )

        waiting = 0
        for batch in batches:
            for texts in _slices(batch.column(0)):
                _, _, first, second, _, _ = _windows(texts, width)
                if not len(first):
                    continue
                for row, cells in enumerate(_cells(first, second, cell_bits)):
                    held[row].append(cells)
                waiting += len(first)
                if waiting >= WINDOWS_IN_SKETCH:
                    yield from give_out()
                    waiting = 0
        yield from give_out()

    def merge(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << block_bits, np.uint8)
        for name in ("one", "two"):
            for data in table.column(name).to_pylist():
                cells = unpack_sorted(data)
                counts[cells] = np.minimum(counts[cells] + 1, 2)
        row, block = table.column("row")[0].as_py(), table.column("block")[0].as_py()
        bits = np.packbits(counts > 1, bitorder="little").tobytes() if (counts > 1).any() else b""
        return pa.table({"row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int32()), "bits": [bits]})

    sketches = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(
        count, "row int, block int, one binary, two binary"
    )
    merged = sketches.groupBy("row", "block").applyInArrow(merge, "row int, block int, bits binary")
    rows = [np.zeros((1 << cell_bits) // 8 or 1, np.uint8) for _ in range(2)]
    # At most 2 * 2**cell_bits / 8 bytes whatever the corpus: the bound of the broadcast.
    for x in merged.filter("length(bits) > 0").toLocalIterator():
        at = (x.block << block_bits) >> 3
        rows[x.row][at : at + len(x.bits)] = np.frombuffer(x.bits, np.uint8)
    return rows


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, cell_bits: int = CELL_BITS, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of ``width`` words covers it whose words also start in a document with a
    smaller id. Null and empty texts have no words. Texts with fewer words than ``width`` lose none.
    Rows that repeat an id do not count against one another; rows without an id neither lose words
    nor count as the source of others. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    count = buckets(spark)
    bits = spark.sparkContext.broadcast(repeated_cells(docs, width, cell_bits, text))
    chunked = chunks(docs, text, id_column)

    def send(table: pa.Table) -> pa.Table:
        ids, texts = documents_of(table)
        chunk = table.column("chunk")[0].as_py()
        known = np.array([i is not None for i in ids])
        ids = np.array([i or 0 for i in ids], np.int64)
        _, _, first, second, at, owner = _windows(texts, width)
        if not known.all():
            first, second, at, owner = (x[known[owner]] for x in (first, second, at, owner))
        again = np.ones(len(first), bool)
        for cells, row in zip(_cells(first, second, cell_bits), bits.value, strict=True):
            again &= ((row[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).astype(bool)
        first, second, at, ids_at = first[again], second[again], at[again], ids[owner[again]]
        extra = (second & np.uint64(0xFFFF)).astype(np.uint16)
        order = np.lexsort((at, ids_at, extra, first))
        new = np.ones(len(order), bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (extra[order][1:] != extra[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = ids_at[order][new][np.cumsum(new) - 1] if len(order) else []
        here = ids_at > least  # a smaller id of this chunk has the window
        rows = [(count + chunk % count, chunk, pack_sorted(at[here]))]
        first, extra, at, ids_at = first[~here], extra[~here], at[~here], ids_at[~here]
        bucket = ((second[~here] >> np.uint64(16)) % np.uint64(count)).astype(np.int64)
        for b in np.unique(bucket).tolist():
            x = bucket == b
            turn = np.flatnonzero(np.diff(ids_at[x], prepend=ids_at[x][0] - 1))
            runs_of = np.diff(turn, append=x.sum()).astype(np.uint32)
            doc = pack(np.column_stack([ids_at[x][turn], runs_of.astype(np.int64)]))
            rows.append((b, chunk, pack(first[x]), pack(extra[x]), pack_sorted(at[x]), doc))
        return packed_rows(rows)

    def group(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= count:
            return table.select(["bucket", "chunk", "a", "b", "c", "d"])
        rows = table.to_pylist()
        first = [unpack(r["a"], np.uint64) for r in rows]
        extra = np.concatenate([unpack(r["b"], np.uint16) for r in rows])
        docs_of = [unpack(r["d"], np.int64).reshape(-1, 2) for r in rows]
        ids = np.concatenate([np.repeat(d[:, 0], d[:, 1]) for d in docs_of])
        sizes = [len(x) for x in first]
        first = np.concatenate(first)
        order = np.lexsort((ids, extra, first))
        new = np.ones(len(order), bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (extra[order][1:] != extra[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = ids[order][new][np.cumsum(new) - 1]
        cut = np.split(ids > least, np.cumsum(sizes)[:-1])
        return packed_rows(
            [
                (bucket, r["chunk"], pack_sorted(unpack_sorted(r["c"])[flags]))
                for r, flags in zip(rows, cut, strict=True)
                if flags.any()
            ]
        )

    def cut_out(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = documents_of(table)
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        depth = np.zeros(sizes.sum() + width + 1, np.int32)
        for data in replies.column("a").to_pylist():
            at = unpack_sorted(data)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + width, -1)
        kept = np.cumsum(depth)[: sizes.sum()] == 0
        ends = np.cumsum(sizes)
        out = []
        for i, w, n, end in zip(ids, words, sizes.tolist(), ends.tolist(), strict=True):
            stay = kept[end - n : end]
            left = int(stay.sum())
            text = b" ".join(w if left == n else compress(w, stay.tolist()))
            out.append((i, n, n - left, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace")))
        part = list(zip(*out, strict=True))
        return pa.table(
            {
                "doc_id": pa.array(part[0], pa.int64()),
                "n_words": pa.array(part[1], pa.int64()),
                "n_removed": pa.array(part[2], pa.int64()),
                "kept_sha256": pa.array(part[3], pa.string()),
                "kept_text": pa.array(part[4], pa.string()),
            }
        )

    replies = chunked.groupBy("chunk").applyInArrow(send, PACKED).groupBy("bucket").applyInArrow(group, PACKED)
    return (
        chunked.groupBy("chunk").cogroup(replies.select("chunk", "a").groupBy("chunk")).applyInArrow(cut_out, RESULT)
    )
