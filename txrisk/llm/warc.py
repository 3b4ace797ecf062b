"""WARC archives as a PySpark data source, format name ``warc``.

Reading: files are planned into partitions by size; filters on the record type and on headers are
pushed down; a record's headers are parsed first, and the block of a record that is filtered out, or
whose payload is not asked for (option ``payload`` = ``false``), is skipped without being decoded.
Writing: a task writes its own files, which the commit moves into place, so that repeated and lost
tasks leave nothing behind. A file is closed at ``max_bytes``.

Files are opened with pyarrow's file systems on the executors, so a folder may be any URI they know.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, "
    "refers_to string, content_length long, headers map<string,string>, payload binary"
)
#: Column and its header.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
#: Names of headers are read in any case; these are given out as written here, others as in the archive.
NAMES = {n.lower(): n for n in (*HEADERS.values(), "Content-Length", "Content-Type", "WARC-Profile")}
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 128 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.most = int(options.get("max_partition_bytes", FILE_BYTES))
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[column] = self.equal.get(column, values) & values
            elif not (column in HEADERS and isinstance(f, IsNotNull) and column == "record_type"):
                yield f

    def partitions(self) -> list[Files]:
        system, root = _open(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted(
            (f for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and "/_" not in f.path),
            key=lambda f: (-f.size, f.path),
        )
        bins: list[list] = []
        for f in files:
            if bins and bins[-1][0] + f.size <= self.most:
                bins[-1][0] += f.size
                bins[-1][1].append(f.path)
            else:
                bins.append([f.size, [f.path]])
        return [Files(paths) for _, paths in bins] or [Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[c]) in values for c, values in self.equal.items())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        held, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                for headers, payload in records(stream, self._wanted, self.payload):
                    held.append((headers, payload))
                    size += 500 + len(payload or b"")
                    if size > 8 << 20:
                        yield _batch(held)
                        held, size = [], 0
        yield _batch(held)


def read_headers(stream) -> dict[str, str]:
    """The header lines up to the blank one; a line that begins with a blank goes on with the one before.
    Of headers that repeat, the last counts."""
    headers: dict[str, str] = {}
    name = None
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            headers[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = NAMES.get(name.strip().lower(), name.strip())
        headers[name] = value.strip()
    return headers


def records(stream, wanted, with_payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the wanted records of an open archive; headers keep their order."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        headers = read_headers(stream)
        if not headers.get("Content-Length", "").isdecimal():
            raise ValueError(f"record {headers.get('WARC-Record-ID')} has no length")
        length = int(headers["Content-Length"])
        if not with_payload or not wanted(headers):
            stream.seek(length, io.SEEK_CUR)
            if wanted(headers):
                yield headers, None
            continue
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {headers.get('WARC-Record-ID')} is cut off")
        if headers.get("Content-Type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield headers, block


def _batch(rows: list[tuple[dict[str, str], bytes | None]]) -> pa.RecordBatch:
    columns = {c: pa.array([h.get(name) for h, _ in rows], pa.string()) for c, name in HEADERS.items()}
    columns["content_length"] = pa.array([int(h["Content-Length"]) for h, _ in rows], pa.int64())
    columns["headers"] = pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string()))
    columns["payload"] = pa.array([p for _, p in rows], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(row: dict) -> bytes:
    """One record from the columns of SCHEMA; a revisit has the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if row["record_type"] == "revisit" else row["payload"] or b"")
    lines = [VERSION, *(f"{h}: {_line(row[c])}" for c, h in HEADERS.items() if row.get(c) is not None)]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {IDENTICAL}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Columns by the names of SCHEMA; those that are missing are left out of the headers."""

    def __init__(self, options: dict, names: list[str]):
        self.path = options["path"].rstrip("/")
        self.gz = options.get("compression", "gzip") == "gzip"
        self.most = int(options.get("max_bytes", FILE_BYTES))
        self.names = names
        self.job = uuid.uuid4().hex

    def _root(self) -> tuple[pafs.FileSystem, str, str]:
        system, root = _open(self.path)
        return system, root, posixpath.join(root, f"_temporary-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, folder = self._root()
        system.create_dir(folder, recursive=True)
        paths: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
                for values in zip(*columns, strict=True):
                    if out is None or size > self.most:
                        if out:
                            out.close()
                        paths.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.gz else ''}")
                        out, size = system.open_output_stream(posixpath.join(folder, paths[-1]), compression=None), 0
                    data = record(dict(zip(self.names, values, strict=True)))
                    data = gzip.compress(data, 3, mtime=0) if self.gz else data
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, folder = self._root()
        system.create_dir(root, recursive=True)
        for m in messages:
            for path in m.paths if m else ():
                system.move(posixpath.join(folder, path), posixpath.join(root, path))
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, folder = self._root()
        self._clear(system, folder)

    @staticmethod
    def _clear(system: pafs.FileSystem, folder: str) -> None:
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("warc archives are appended to, not overwritten")
        return WarcWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives below ``path``; filter it by type or header before anything else."""
    register(spark)
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    options = {"payload": str(payload).lower(), "max_partition_bytes": str(min(most, FILE_BYTES))}
    return spark.read.format("warc").options(**options).load(path)


def write_warc(records_of: DataFrame, path: str, compression: str = "gzip") -> None:
    """Append the rows (columns of SCHEMA) as archives below ``path``."""
    register(records_of.sparkSession)
    records_of.write.format("warc").option("compression", compression).mode("append").save(path)
