"""Jaccard self-join on word shingles with multiple-global-order filtering.

Documents of the same words are one class. A bucket exchange of packed shingles counts in how many
classes each shingle occurs; shingles of one class cannot be shared, so only repeated ones come back.
Two sets of similarity ``t`` share at least one shingle among the first ``n - ceil(t n) + 1`` of each
under *any* global order. Three orders are used: by frequency, by frequency rank of powers of two, and
by powers of two with other ties, rare shingles first. Candidates must share a prefix shingle under
every order, and pass the length and position bounds; they are verified by their exact overlap.

Large groups of near copies never meet as all pairs: each class is first paired with some leaders of
each prefix shingle's list, and pairs whose members are already linked through leaders are not made. All
other candidate pairs are, so no link between different components is lost. The components are exact; the
links are a connecting subset of all true ones, since those within a component already joined are not made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txrisk.llm.components import connected, partly_connected
from txrisk.llm.frames import PACKED, left_out, pack, packed_rows, store, unpack
from txrisk.llm.words import shingle_sets

WIDTH = 5
SIMILARITY = 75
#: Classes of a posting list that the others are paired with, round by round, before all pairs of
#: classes that are still apart. Few are apart later, so more leaders cost little.
LEADERS = (8, 128)

KEYED = "doc_id long, text_hash long, digest binary, chunk int, text binary"
CLASSES = (
    "uid long, digest binary, n long, shingles array<long>, "
    "order_a array<long>, order_b array<long>, order_c array<long>"
)
TOKEN_BITS = 48
#: Classes of a posting list that one task meets all others with.
SPLIT = 512


def _words_digest(text: bytes | None) -> tuple[bytes, bytes]:
    """The words in lower case (A-Z), joined by one space, and their digest."""
    plain = b" ".join((text or b"").lower().split())
    return plain, hashlib.sha256(plain).digest()[:16]


def _keyed(docs: DataFrame, text: str, id_column: str, with_text: bool, count: int) -> DataFrame:
    """Per row: id, digest of its words, chunk. With the text, a task gives out each digest once."""

    def read(batches):
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for i, h, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                plain, digest = _words_digest(t)
                if with_text and (digest in seen or not plain):
                    continue
                if with_text:
                    seen.add(digest)
                chunk = int.from_bytes(digest[:4], "big") % count
                out.append((i, h, digest, chunk, plain if with_text else None))
            part = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[0], pa.int64()),
                    pa.array(part[1], pa.int64()),
                    pa.array(part[2], pa.binary()),
                    pa.array(part[3], pa.int32()),
                    pa.array(part[4], pa.binary()),
                ],
                ["doc_id", "text_hash", "digest", "chunk", "text"],
            )

    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).cast("binary").alias("text"),
    )
    return source.mapInArrow(read, KEYED)


def _mixed(tokens: np.ndarray, factor: int) -> np.ndarray:
    x = tokens.astype(np.uint64) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def shingle_classes(docs: DataFrame, similarity: int = SIMILARITY, width: int = WIDTH, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per distinct word sequence: uid, digest, size of its set and, if at least ``similarity``
    percent of the set occurs in other classes, its repeated shingles and its prefixes under three orders.
    """
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))  # chunks, and buckets of shingles

    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        rows = dict(zip(table.column("digest").to_pylist(), table.column("text").to_pylist(), strict=True))
        digests = sorted(rows)
        sets = shingle_sets([rows[d].split() for d in digests], width)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        tokens = np.concatenate(sets) >> np.uint64(64 - TOKEN_BITS)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        bucket = (tokens % np.uint64(count)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(count + 1))
        out = [(count + chunk, chunk, pack(sizes), b"".join(digests))]
        for b in np.flatnonzero(np.diff(edges)).tolist():
            x = order[edges[b] : edges[b + 1]]
            six = tokens[x].view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8]
            out.append((b, chunk, pack(six), pack(np.diff(owner[x], prepend=np.uint32(0)))))
        return packed_rows(out)

    def tally(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= count:
            return table.select(["bucket", "chunk", "a", "b", "c", "d"])
        rows = table.to_pylist()
        parts = []
        for r in rows:
            six = unpack(r["a"], np.uint8).reshape(-1, TOKEN_BITS // 8)
            eight = np.zeros((len(six), 8), np.uint8)
            eight[:, : TOKEN_BITS // 8] = six
            parts.append(eight.view(np.uint64).ravel())
        _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        frequency = np.split(counts[inverse], np.cumsum([len(p) for p in parts])[:-1])
        out = []
        for r, tokens, df in zip(rows, parts, frequency, strict=True):
            again = df > 1
            if again.any():
                owner = np.cumsum(unpack(r["b"], np.uint32), dtype=np.uint32)[again]
                shorter = np.minimum(df[again], 2**32 - 1).astype(np.uint32)
                out.append(
                    (bucket, r["chunk"], pack(tokens[again]), pack(np.diff(owner, prepend=np.uint32(0))), pack(shorter))
                )
        return packed_rows(out)

    def gather(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        rows = table.to_pylist()
        head = next(r for r in rows if r["bucket"] >= count)
        sizes = unpack(head["a"], np.int64)
        digests = [head["b"][k : k + 16] for k in range(0, len(head["b"]), 16)]
        rest = [r for r in rows if r["bucket"] < count]
        none = np.zeros(0, np.int64)
        tokens = np.concatenate([none, *(unpack(r["a"], np.int64) for r in rest)])
        owner = np.concatenate([none, *(np.cumsum(unpack(r["b"], np.uint32), dtype=np.uint32) for r in rest)])
        df = np.concatenate([none, *(unpack(r["c"], np.uint32) for r in rest)])
        order = np.lexsort((tokens, owner))
        edges = np.searchsorted(owner[order], np.arange(len(sizes) + 1))
        arrays: list[list] = [[], [], [], []]
        for k, n in enumerate(sizes.tolist()):
            x = order[edges[k] : edges[k + 1]]
            need = -(-n * similarity // 100)
            first = n - need + 1 - (n - len(x))  # repeated shingles in a prefix; those of one class come first
            if first < 1:
                for a in arrays:
                    a.append(None)
                continue
            own, f = tokens[x], df[x]
            level = np.frexp(f.astype(np.float64))[1]
            arrays[0].append(own)
            arrays[1].append(own[np.lexsort((own, f))][:first])
            arrays[2].append(own[np.lexsort((_mixed(own, 0x9E3779B97F4A7C15), level))][:first])
            arrays[3].append(own[np.lexsort((_mixed(own, 0xD6E8FEB86659FD93), level))][:first])
        longs = pa.list_(pa.int64())
        return pa.table(
            {
                "uid": pa.array((np.int64(chunk) << np.int64(32)) + np.arange(len(sizes), dtype=np.int64)),
                "digest": pa.array(digests, pa.binary()),
                "n": pa.array(sizes),
            }
            | {
                name: pa.array(a, longs)
                for name, a in zip(("shingles", "order_a", "order_b", "order_c"), arrays, strict=True)
            }
        )

    distinct = _keyed(docs, text, id_column, True, count).select("digest", "chunk", "text")
    sent = distinct.groupBy("chunk").applyInArrow(send, PACKED)
    counted = sent.groupBy("bucket").applyInArrow(tally, PACKED)
    return counted.groupBy("chunk").applyInArrow(gather, CLASSES)


def _could_link(a: str, b: str, similarity: int) -> Column:
    """Length and position bounds of a pair that shares the shingle at places ``pos``."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    best = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (
        (na * 100 >= nb * similarity)
        & (nb * 100 >= na * similarity)
        & (best * (100 + similarity) >= (na + nb) * similarity)
    )


def _verified(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Of pairs (a, b): those that share a prefix shingle under the other orders and whose overlap is enough."""
    names = ["uid", "n", "shingles", "order_b", "order_c"]
    left = classes.select(*(F.col(n).alias(f"a_{n}") for n in names))
    right = classes.select(*(F.col(n).alias(f"b_{n}") for n in names))
    both = pairs.join(left, F.col("a") == F.col("a_uid")).join(right, F.col("b") == F.col("b_uid"))
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return (
        both.filter(F.arrays_overlap("a_order_b", "b_order_b") & F.arrays_overlap("a_order_c", "b_order_c"))
        .select("a", "b", shared.alias("shared"), (F.col("a_n") + F.col("b_n") - shared).alias("union"))
        .filter(F.col("shared") * 100 >= F.col("union") * similarity)
        .select("a", "b", "shared", "union")
    )


def _open_lists(postings: DataFrame, stars: DataFrame, done: int) -> DataFrame:
    """The postings of lists that still hold pairs to be made: of more than ``done`` classes, in several
    parts as far as ``stars`` (a, b) tell. Each with its part and the size of its list."""
    nearest = stars.groupBy("a").agg(F.min("b").alias("part"))
    named = stars.select("b").distinct().select(F.col("b").alias("a"), F.col("b").alias("part"))
    # A node that others are tied to is its own part unless it is tied to a smaller one itself.
    part_of = nearest.unionByName(named).groupBy("a").agg(F.min("part").alias("part")).withColumnRenamed("a", "uid")
    marked = postings.drop("part", "size").join(part_of, "uid", "left").withColumn("part", F.coalesce("part", "uid"))
    several = (
        marked.groupBy("token")
        .agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size"))
        .filter((F.col("lo") != F.col("hi")) & (F.col("size") > done))
    )
    return store(marked.join(several.select("token", "size"), "token"), "open")


def _salted(members: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``: the members of a list are dealt into splits of about SPLIT classes, the
    others go to every split of their list, so that no task meets a whole long list."""
    splits = F.ceil(F.col("size") / SPLIT).cast("int")
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("uid", "token"), splits).cast("int"))
    return dealt, others.withColumn("salt", F.explode(F.sequence(F.lit(0), splits - 1)))


def _pairs(members: DataFrame, others: DataFrame, similarity: int, both: bool = False) -> DataFrame:
    """Distinct pairs a < b of different parts that share a posting list and pass the bounds.

    ``both`` says that both sides are the same, so that each pair is made once."""
    dealt, everywhere = _salted(members, others)
    return (
        dealt.alias("m")
        .join(everywhere.alias("l"), ["token", "salt"])
        .filter(F.col("m.part") != F.col("l.part"))
        .filter(_could_link("m", "l", similarity) & (F.lit(not both) | (F.col("m.uid") < F.col("l.uid"))))
        .select(F.least("m.uid", "l.uid").alias("a"), F.greatest("m.uid", "l.uid").alias("b"))
        .distinct()
    )


def class_links(
    classes: DataFrame, similarity: int = SIMILARITY, leaders: tuple[int, ...] = LEADERS
) -> DataFrame:
    """Links (a, b) between classes that connect all that are connected, and no others.

    Each round pairs the classes of a list with some of them, its leaders; lists of no more classes
    than leaders are done then, and so are lists whose classes are all in one part. Links found are
    tied to stars between the rounds. What is open after the rounds is paired in full, in splits.
    """
    likely = classes.filter("shingles IS NOT NULL")
    postings = likely.select(
        "uid",
        "n",
        F.posexplode("order_a").alias("place", "token"),
        (F.col("n") - F.size("shingles")).alias("alone"),
    ).select("uid", "n", "token", (F.col("alone") + F.col("place")).cast("long").alias("pos"), F.col("uid").alias("part"))
    sizes = postings.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    postings = store(postings.join(sizes, "token"), "postings")
    links = None
    for k, most in enumerate(leaders):
        rank = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("uid", F.lit(k)), "uid"))
        chosen = postings.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
        found = store(_verified(_pairs(postings, chosen, similarity), likely, similarity).select("a", "b"), "links")
        links = partly_connected(found if links is None else links.unionByName(found))
        postings = _open_lists(postings, links, most)
        if postings.isEmpty():
            return links
    rest = _verified(_pairs(postings, postings, similarity, both=True), likely, similarity).select("a", "b")
    return links.unionByName(store(rest, "links"))


def near_groups(
    docs: DataFrame,
    similarity: int = SIMILARITY,
    width: int = WIDTH,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_size, words_digest, text_hash.

    Two documents link when ``100 * |A & B| >= similarity * |A | B|`` for their sets of distinct
    ``width``-word shingles (fewer words: the whole sequence as one). A document without words has
    an empty set, links with nothing and is its own component. ``component_id`` is the smallest id
    reachable by links. Rows of one word sequence are one class whatever their ids, null ids too; a
    component without any id has a null ``component_id``. An empty table gives no rows. The number of
    links of a document is not given: only a subset that connects each component is verified.
    """
    classes = store(shingle_classes(docs, similarity, width, text, id_column), "classes")
    groups = connected(class_links(classes, similarity))
    members = store(_keyed(docs, text, id_column, False, 1).select("doc_id", "text_hash", "digest"), "members")
    sizes = members.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"))
    known = (
        classes.select("uid", "digest", "n")
        .join(groups.withColumnRenamed("node", "uid"), "uid", "left")
        .join(sizes, "digest")
        .withColumn("part", F.coalesce("part", "uid"))
    )
    known = store(known, "known")
    least = known.groupBy("part").agg(F.min("least").alias("component_id"))
    per_class = known.join(least, "part").select("digest", "n", "component_id", "class_size")
    none = F.col("n").isNull()
    return members.join(per_class, "digest", "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(none, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.lower(F.hex("digest")).alias("words_digest"),
        "text_hash",
    )


def keep_one(
    docs: DataFrame, similarity: int = SIMILARITY, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id; its columns as they are.

    Documents without words all stay, and so do those without an id unless their component has one.
    Rows that repeat the kept id and its words stay together: dropping equal rows is exact
    de-duplication's work.
    """
    groups = near_groups(docs, similarity, text=text, id_column=id_column)
    drop = groups.filter("component_id IS NOT NULL AND NOT (doc_id <=> component_id)")
    dropped = store(drop.select("doc_id", "text_hash").distinct(), "dropped")
    return left_out(docs, dropped, F.col(f"`{id_column}`").cast("long"), F.xxhash64(text))
