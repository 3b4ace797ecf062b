"""Tables as versions behind one pointer.

A table is a folder with a folder for each bucket and version, and a view that names the current ones.
Rows go to new folders first; replacing the view's definition is the one step that readers see. So a reader
finds the old version or the new one, never none and never a mixture, and a crash leaves the old version and
some folders that ``vacuum`` removes. Folders of buckets that did not change are shared by versions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txrisk.sources.staging import shared_folder

BUCKET = "_bucket"
STATE = "txrisk.state"


@dataclass(frozen=True)
class State:
    """What a version consists of: for each folder the buckets that are read from it, and facts that the
    writer wants to keep."""

    root: str
    key: str
    buckets: int
    folders: dict[str, list[int]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)

    def pattern(self) -> str:
        """All the folders as one path pattern, so that a reader plans one scan."""
        parts = [f"{f}/{BUCKET}={b}" for f, bs in sorted(self.folders.items()) for b in bs]
        return f"{self.root}/{{{','.join(parts)}}}"

    def paths(self) -> list[str]:
        return [f"{self.root}/{f}/{BUCKET}={b}" for f, bs in sorted(self.folders.items()) for b in bs]


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a key; NULL keys have one too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def state_of(spark: SparkSession, table: str) -> State | None:
    """The current version, read from the pointer; None if there is no such table."""
    if not spark.catalog.tableExists(table):
        return None
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if STATE not in found:
        raise ValueError(f"{table} is no versioned table")
    return State(**json.loads(found[STATE]))


def write_buckets(df: DataFrame, root: str, key: str, buckets: int) -> dict[str, list[int]]:
    """Write the rows to a new folder with one for each bucket that has rows; nothing points to it yet.

    The rebalance hint writes a large bucket as several files: a bucket is as large as its keys are hot.
    """
    folder = uuid.uuid4().hex
    marked = df.withColumn(BUCKET, bucket_of(key, buckets))
    marked.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    written = df.sparkSession.read.schema(marked.schema).parquet(f"{root}/{folder}")
    present = sorted(r[0] for r in written.select(BUCKET).distinct().collect())  # names of folders only
    return {folder: present} if present else {}


def point_to(spark: SparkSession, table: str, state: State, columns: StructType) -> None:
    """Make ``state`` the current version: the one step that readers see."""
    names = ", ".join(f"`{f.name}`" for f in columns)
    empty = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in columns)
    rows = f"SELECT {names} FROM parquet.`{state.pattern()}`" if state.folders else f"SELECT {empty} WHERE false"
    stored = json.dumps(state.__dict__).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ('{STATE}' = '{stored}') AS {rows}")


def publish(
    df: DataFrame,
    table: str,
    key: str = "user_id",
    buckets: int = 64,
    facts: dict | None = None,
    only: set[int] | None = None,
) -> State:
    """Write ``df`` as the next version of ``table`` and point to it.

    With ``only``, ``df`` has all rows of these buckets and none of others, whose folders stay as they are.
    """
    spark = df.sparkSession
    before = state_of(spark, table)
    if before and (before.key, before.buckets) != (key, buckets):
        raise ValueError(f"{table} has {before.buckets} buckets by {before.key}")
    root = before.root if before else f"{shared_folder(spark)}/tables/{table}-{uuid.uuid4().hex}"
    kept = before.folders if before and only is not None else {}
    folders = {f: left for f, bs in kept.items() if (left := [b for b in bs if b not in only])}
    folders |= write_buckets(df, root, key, buckets)
    after = State(root, key, buckets, folders, facts if facts is not None else (before.facts if before else {}))
    point_to(spark, table, after, df.schema)
    return after


def vacuum(spark: SparkSession, table: str) -> list[str]:
    """Delete the folders of ``table`` that its current version does not use; call it when no reader
    of older versions is left. Gives the folders deleted."""
    state = state_of(spark, table)
    path = spark._jvm.org.apache.hadoop.fs.Path(state.root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for version in files.listStatus(path):
        at = version.getPath()
        used = {f"{BUCKET}={b}" for b in state.folders.get(at.getName(), [])}
        parts = [x.getPath() for x in files.listStatus(at)] if used else [at]
        for part in parts:
            if not used or (part.getName().startswith(f"{BUCKET}=") and part.getName() not in used):
                files.delete(part, True)
                gone.append(part.toString())
    return gone
