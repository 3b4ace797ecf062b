"""Byte-level BPE through a table of distinct words.

Texts are split into words with their leading blanks. Documents are dealt into chunks; a chunk sends
its distinct words to buckets, where each distinct word is encoded once; the ids come back to the
chunk and are joined to its texts by position. Decoding joins the ids to the vocabulary's pieces, in the
table of distinct words for texts that were just encoded, by ``decode`` for any ids.

A word begins with blanks and ends before the next blank, which the tokenizer's own pattern never
crosses, so the words' ids in a row are the text's ids. A text with other white space or with a
special token's string is one word as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
from itertools import chain
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from txrisk.llm.frames import PACKED, buckets, chunks, documents_of, packed_rows

#: White space other than space and line feed.
OTHER_BLANKS = "\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(r"[ \n]*[^ \n]+|[ \n]+")

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer(source: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(source)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces(source: str) -> dict[int, bytes]:
    """The bytes of each id. Byte-level vocabularies write bytes that are no visible Latin-1
    character as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown}
    byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in byte.values())}
    data = json.loads(source)
    table = {i: bytes(byte[c] for c in piece) for piece, i in data["model"]["vocab"].items()}
    return table | {x["id"]: x["content"].encode() for x in data["added_tokens"]}


def splitter(source: str):
    """A function from a text to its words."""
    special = [re.escape(x["content"]) for x in json.loads(source)["added_tokens"]]
    whole = re.compile("|".join([f"[{OTHER_BLANKS}]", *special])).search
    find = WORD.findall
    return lambda text: [text] if whole(text) else find(text)


def _in_buckets(words: dict[str, None], count: int) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for word in words:
        out.setdefault(xxh3_64_intdigest(word.encode()) % count, []).append(word)
    return out


#: A byte that UTF-8 never has, between packed words.
BETWEEN = b"\xff"


def _encoded(docs: DataFrame, finish, schema: str, path: str | None, text: str, id_column: str) -> DataFrame:
    """``finish(doc_ids, texts as words, numbers, decoded)`` for every chunk: the word table has each
    word's ids as decimal numbers joined by commas, and the bytes of their pieces."""
    spark = docs.sparkSession
    count = buckets(spark)
    source = spark.sparkContext.broadcast(Path(path or default_path()).read_text(encoding="utf-8"))
    chunked = chunks(docs, text, id_column)

    def read_chunk(table: pa.Table) -> tuple[list, list[str], dict[int, list[str]]]:
        """Ids, texts and the distinct words by bucket; the words of one text at a time."""
        split = splitter(source.value)
        ids, texts = documents_of(table)
        texts = [t.decode("utf-8", "replace") for t in texts]
        distinct: dict[str, None] = {}
        for t in texts:
            distinct.update(dict.fromkeys(split(t)))
        return ids, texts, _in_buckets(distinct, count)

    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, _, own = read_chunk(table)
        return packed_rows(
            [(b, chunk, zstandard.compress(BETWEEN.join(w.encode() for w in words), 3)) for b, words in own.items()]
        )

    def encode(table: pa.Table) -> pa.Table:
        lists = [zstandard.decompress(a).split(BETWEEN) for a in table.column("a").to_pylist()]
        distinct = list(dict.fromkeys(chain.from_iterable(lists)))
        tokenizer, piece = _tokenizer(source.value), pieces(source.value)
        numbers: dict[bytes, str] = {}
        changed: dict[bytes, bytes] = {}  # words whose ids decode to other bytes
        for k in range(0, len(distinct), 10_000):
            part = distinct[k : k + 10_000]
            for w, x in zip(part, tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                ids = x.ids
                numbers[w] = ",".join(map(str, ids))
                decoded = b"".join(map(piece.__getitem__, ids))
                if decoded != w:
                    changed[w] = decoded
        rows = []
        for bucket, chunk, words in zip(*(table.column(n).to_pylist() for n in ("bucket", "chunk")), lists, strict=True):
            reply = "\n".join(map(numbers.__getitem__, words)).encode()
            other = [BETWEEN.join([w, changed[w]]) for w in words if w in changed] if changed else []
            rows.append((bucket, chunk, zstandard.compress(reply, 3), pickle.dumps(other)))
        return packed_rows(rows)

    def join_back(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts, own = read_chunk(table)
        numbers: dict[str, str] = {}
        decoded: dict[str, bytes] = {}
        for bucket, a, b in zip(*(replies.column(n).to_pylist() for n in ("bucket", "a", "b")), strict=True):
            words = own.pop(bucket)
            numbers.update(zip(words, zstandard.decompress(a).decode().split("\n"), strict=True))
            for w, other in (x.split(BETWEEN) for x in pickle.loads(b)):
                decoded[w.decode()] = other
        if own:
            raise ValueError("a chunk was read in another order; store the documents first")
        split = splitter(source.value)
        return finish(ids, map(split, texts), numbers, decoded)

    sent = chunked.groupBy("chunk").applyInArrow(send, PACKED)
    replies = sent.groupBy("bucket").applyInArrow(encode, PACKED)
    return (
        chunked.groupBy("chunk")
        .cogroup(replies.select("chunk", "bucket", "a", "b").groupBy("chunk"))
        .applyInArrow(join_back, schema)
    )


def encode(docs: DataFrame, path: str | None = None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the token ids of every text, in order. Null and empty texts have none.

    One row per row of ``docs``, rows that repeat an id too; other columns are not read.
    """

    def finish(doc_ids, texts, numbers, decoded):
        ids = [[int(x) for x in ",".join(map(numbers.__getitem__, t)).split(",")] if t else [] for t in texts]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return _encoded(docs, finish, "doc_id long, ids array<int>", path, text, id_column)


def piece_table(spark, path: str | None = None) -> DataFrame:
    """(id, piece): as many rows as the vocabulary has ids."""
    table = pieces(Path(path or default_path()).read_text(encoding="utf-8"))
    return spark.createDataFrame(list(table.items()), "id int, piece binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), by joining ids to pieces and the pieces by position.

    The vocabulary is broadcast, its size is fixed by its file. Ids outside it give nothing, bytes
    that are no UTF-8 the replacement character; no ids give the empty text.
    """
    table = piece_table(encoded.sparkSession, path)
    numbered = encoded.select("doc_id", F.monotonically_increasing_id().alias("row"), "ids")
    parts = numbered.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(
        F.broadcast(table), "id", "left"
    )
    in_order = F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("hex"))))
    joined = F.unhex(F.array_join(F.transform(in_order, lambda x: x["hex"]), ""))
    text = F.make_valid_utf8(joined.cast("string")).alias("text")
    return parts.groupBy("row", "doc_id").agg(text).select("doc_id", "text")


def digests(docs: DataFrame, path: str | None = None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: number of tokens, digest of the ids, digest of the text decoded from them."""

    def finish(doc_ids, texts, numbers, decoded):
        out: list[list] = [[], [], []]
        for t in texts:
            ids = ",".join(map(numbers.__getitem__, t))
            back = b"".join(decoded.get(w) or w.encode() for w in t) if decoded else "".join(t).encode()
            out[0].append(ids.count(",") + 1 if t else 0)
            out[1].append(hashlib.sha256(ids.encode()).hexdigest())
            out[2].append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "n_tokens": pa.array(out[0], pa.int64()),
                "ids_sha256": pa.array(out[1], pa.string()),
                "decoded_sha256": pa.array(out[2], pa.string()),
            }
        )

    return _encoded(docs, finish, RESULT, path, text, id_column)
