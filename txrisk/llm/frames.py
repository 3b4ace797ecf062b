"""Helpers shared by the corpus operators: stored intermediate frames, packed columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows of a packed exchange: a bucket, the chunk of documents it comes from, four arrays.
PACKED = "bucket int, chunk long, a binary, b binary, c binary, d binary"
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
CHUNKS = "chunk long, ids binary, known binary, sizes binary, texts binary"

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session may lack one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="txrisk-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def left_out(docs: DataFrame, gone: DataFrame, *keys: Column) -> DataFrame:
    """``docs`` without the rows whose ``keys`` are a row of ``gone``, nulls like values; its columns as they
    are, whatever their names: each row is carried as one value."""
    row = F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row")
    held = docs.select(row, *(k.alias(f"own{i}") for i, k in enumerate(keys)))
    names = [f"gone{i}" for i in range(len(keys))]
    same = [F.col(f"own{i}").eqNullSafe(F.col(n)) for i, n in enumerate(names)]
    return held.join(gone.toDF(*names), same, "left_anti").select(*(F.col(f"row.`{n}`").alias(n) for n in docs.columns))


def buckets(spark: SparkSession) -> int:
    """How many chunks and buckets an exchange uses: twice the shuffle partitions."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, which compress well."""
    return pack(np.diff(values.astype(np.int64), prepend=0).astype(np.uint32))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint32), dtype=np.int64)


def packed_rows(rows: list[tuple]) -> pa.Table:
    """Rows of PACKED; trailing arrays may be left out."""
    full = [r + (b"",) * (6 - len(r)) for r in rows]
    part = list(zip(*full, strict=True)) or [()] * 6
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.table(
        {n: pa.array(list(v), k) for n, v, k in zip(("bucket", "chunk", *"abcd"), part, kinds, strict=True)}
    )


def chunks(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Whole documents packed into chunks of some megabytes, one row each (CHUNKS).

    A chunk's number comes from its content and place. Both uses of the frame in one query read the
    same exchange; should a chunk be rebuilt otherwise (an input without a stable order), its number
    differs and the reader finds no answers instead of wrong ones.
    """

    def run(batches):
        where = TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        size = made = 0

        def give_out():
            ids = np.array([i or 0 for i, _ in held], np.int64)
            known = np.array([i is not None for i, _ in held], np.uint8)
            sizes = np.array([len(t) for _, t in held], np.int64)
            data = b"".join(t for _, t in held)
            number = xxh3_64_intdigest(data, xxh3_64_intdigest(ids.tobytes(), (where << 20) + made))
            values = [number - (1 << 63), pack(ids), pack(known), pack(sizes), zstandard.compress(data, 3)]
            kinds = [pa.int64(), *[pa.binary()] * 4]
            names = [x.split()[0] for x in CHUNKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((i, t.as_py() or b""))
                size += len(held[-1][1]) + 16
                if size >= CHUNK_BYTES:
                    yield give_out()
                    held, size, made = [], 0, made + 1
        if held:
            yield give_out()

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, CHUNKS)


def documents_of(row: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and texts of the one chunk in ``row``; null texts are empty."""
    if row.num_rows != 1:
        raise ValueError("two chunks have one number")
    data = {n: row.column(n)[0].as_py() for n in ("ids", "known", "sizes", "texts")}
    known = unpack(data["known"], np.uint8).tolist()
    ids = [i if k else None for i, k in zip(unpack(data["ids"], np.int64).tolist(), known, strict=True)]
    ends = np.cumsum(unpack(data["sizes"], np.int64)).tolist()
    text = zstandard.decompress(data["texts"]) if ends[-1] else b""
    return ids, [text[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
