"""SentencePiece encoding through a table of each prefix's last token, and decoding.

Merging adjacent symbols, best score first and leftmost among equals, is the same on a whole text as on
any stretch of it that no merge crosses. So a sequence of tokens is the encoding of a text if and only if
each two neighbours are the encoding of their own characters, and every prefix of a text has one last
token. The table is filled from left to right: an automaton gives all pieces that end at a place, and the
one that is compatible with the last token of the prefix before it is stored. The ids are then recovered
backwards from the end of the text. Pairs are tested by merging their characters, once per pair.

No piece of a usual model goes from another character to a blank, so a text is cut before its blanks, and
around characters that no piece joins with others, such as line feeds and digits. A task works out each
distinct word once, as long as a bounded number of words is remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.piece_model import BLANK, BYTE, CONTROL, UNKNOWN, PieceModel, read_model

#: Characters of a text that are worked on at once.
SEGMENT = 1 << 20
#: Words, and pairs of tokens, that a task remembers.
WORDS_KEPT, PAIRS_KEPT = 1 << 19, 1 << 20
#: Words longer than this are not remembered.
LONGEST_KEPT = 64

#: What stands before the first token; tokens from STRANGE on are characters without a piece.
START, STRANGE = (1 << 22) - 1, 1 << 21
#: The score of two symbols that are never merged.
NEVER = float("-inf")
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("one_by_one", _one_by_one)


class Encoder:
    """Ids of texts. ``prefix_table`` and ``recover`` are the two steps for one word."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, list[tuple[float, str, str]] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, token in model.ids.items():
            self.automaton.add_word(piece, (token, len(piece)))
        self.automaton.make_automaton()
        # No merge takes in a character that is in no piece of several; such ones are words of their own.
        joined = set("".join(p for p in model.ids if len(p) > 1))
        alone = [c for c in map(chr, range(128)) if c not in joined and (c in model.ids or model.byte_ids)]
        apart = re.escape("".join(c for c in alone if c != " "))
        self.find = re.compile(f" *[^ {apart}]+| +|[{apart}]" if apart else " *[^ ]+| +").findall
        self.whole_texts = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in model.ids)

    def _best(self, symbols: list[str]) -> int | None:
        """Where the next merge is: the best score, the leftmost among equals."""
        scores = [self.model.scores.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        best = max(scores, default=NEVER)
        return None if best == NEVER else scores.index(best)

    def _written(self, token: int) -> str:
        return chr(token - STRANGE) if token >= STRANGE else self.model.pieces[token]

    def history(self, token: int) -> list[tuple[float, str, str]] | None:
        """The merges of the token's own characters in order: score, first and last symbol after it.
        The characters come first, with a score of no merge; None if they are not merged into the token."""
        if token not in self.histories:
            symbols = list(self._written(token))
            steps = [(NEVER, symbols[0], symbols[-1])]
            while (best := self._best(symbols)) is not None:
                steps.append((self.model.scores["".join(symbols[best : best + 2])], "", ""))
                symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
                steps[-1] = (steps[-1][0], symbols[0], symbols[-1])
            self.histories[token] = steps if len(symbols) == 1 else None
        return self.histories[token]

    def compatible(self, before: int, token: int) -> bool:
        """Whether the characters of both tokens are merged into just these two (the one, at the start).

        Until a merge crosses the border, both sides go through their own merges, the better of the two
        next ones first; a merge across comes first where it is better than both, and left of equal ones.
        """
        right = self.history(token)
        left = [] if before == START else self.history(before)
        if right is None or left is None:
            return False
        if before == START:
            return True
        scores = self.model.scores
        i = j = 1
        a, b = left[0][2], right[0][1]
        while True:
            across = scores.get(a + b, NEVER)
            next_left = left[i][0] if i < len(left) else NEVER
            next_right = right[j][0] if j < len(right) else NEVER
            if across > next_left and across >= next_right:
                return False
            if next_left >= next_right:
                if next_left == NEVER:
                    return True
                a, i = left[i][2], i + 1
            else:
                b, j = right[j][1], j + 1

    def prefix_table(self, word: str) -> tuple[list[int], list[int]]:
        """The last token of every prefix of ``word`` and its length."""
        pairs = self.pairs
        last, size = [START] * (len(word) + 1), [0] * (len(word) + 1)
        done = 0  # prefixes up to here have their token
        for end, (token, length) in self.automaton.iter(word):
            if end > done:
                if end > done + 1 or not size[end]:
                    self._strange(word, last, size, done, end)
                done = end
            if size[end + 1]:
                continue
            before = last[end + 1 - length]
            fits = pairs.get(before << 22 | token)
            if fits is None:
                if len(pairs) >= PAIRS_KEPT:
                    pairs.clear()
                fits = pairs[before << 22 | token] = self.compatible(before, token)
            if fits:
                last[end + 1], size[end + 1] = token, length
        self._strange(word, last, size, done, len(word))
        return last, size

    @staticmethod
    def _strange(word: str, last: list[int], size: list[int], after: int, upto: int) -> None:
        """Prefixes that no piece ends end in a character that has none."""
        for i in range(after + 1, upto + 1):
            if not size[i]:
                last[i], size[i] = STRANGE + ord(word[i - 1]), 1

    def recover(self, last: list[int], size: list[int]) -> list[int]:
        """Ids of the whole word, from its end to its beginning."""
        out: list[int] = []
        at = len(last) - 1
        by_byte, unknown = self.model.byte_ids, self.model.unknown_id
        while at > 0:
            token = last[at]
            if token < STRANGE:
                out.append(token)
            elif by_byte:
                out.extend(by_byte[b] for b in reversed(chr(token - STRANGE).encode()))
            elif not out or out[-1] != unknown:  # unknown characters in a row are one token
                out.append(unknown)
            at -= size[at]
        out.reverse()
        return out

    def word(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.recover(*self.prefix_table(word.replace(" ", BLANK))))
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[word] = ids
        return ids

    def segments(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, some at a time; none for the empty text."""
        if not text:
            return
        text = text.replace(BLANK, " ")
        if self.model.dummy_prefix:
            text = " " + text
        if self.whole_texts:
            yield list(self.word(text))
            return
        at, known, word = 0, self.words.get, self.word
        while at < len(text):
            end = _cut(text, at + SEGMENT)
            yield list(chain.from_iterable([known(w) or word(w) for w in self.find(text, at, end)]))
            at = end


def _cut(text: str, after: int) -> int:
    """A place from ``after`` on where a blank follows another character, or the end."""
    at = after
    while at < len(text):
        at = text.find(" ", at)
        if at < 0:
            break
        if text[at - 1] != " ":
            return at
        at += 1
    return len(text)


class Decoder:
    """The text of ids that are fed some at a time."""

    def __init__(self, model: PieceModel):
        special = {CONTROL: "", UNKNOWN: " ⁇ "}
        self.surface = [
            special.get(k, p.replace(BLANK, " ")) for p, k in zip(model.pieces, model.kinds, strict=True)
        ]
        self.blank_first = {
            i for i, p in enumerate(model.pieces) if model.dummy_prefix and p.startswith(BLANK)
        }
        self.bytes = {i: int(p[3:5], 16) for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        for i in [i for i, b in self.bytes.items() if b < 128]:  # a character of its own, wherever it is
            self.surface[i] = chr(self.bytes.pop(i))
        self.byte_ids = frozenset(self.bytes)
        self.silent = {i for i, k in enumerate(model.kinds) if k == CONTROL}

    def _flush(self, held: bytearray) -> str:
        text = held.decode("utf-8", "one_by_one") if held else ""
        held.clear()
        return text

    def texts(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """The text of all ids, in pieces. Bytes that are no UTF-8 are U+FFFD, one by one; the first
        piece loses the blank that encoding puts before a text."""
        surface, began = self.surface, False
        held = bytearray()
        for ids in parts:
            if self.byte_ids.isdisjoint(ids):
                text = self._flush(held) + "".join(map(surface.__getitem__, ids))
            else:
                out: list[str] = []
                for i in ids:
                    if i in self.bytes:
                        held.append(self.bytes[i])
                    else:
                        out.append(self._flush(held))
                        out.append(surface[i])
                text = "".join(out)
            if not began:
                first = next((i for i in ids if i not in self.silent), None)
                began = first is not None
                text = text[1:] if first in self.blank_first else text
            yield text
        yield self._flush(held)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _per_row(df: DataFrame, column: str, id_column: str, path: str | None, make, ddl: str) -> DataFrame:
    """Rows ``make(model)`` gives for each (id, value of ``column``)."""
    model = df.sparkSession.sparkContext.broadcast(read_model(Path(path or default_path()).read_bytes()))
    schema = _schema(ddl)

    def run(batches):
        one = make(model.value)
        for b in batches:
            rows, size = [], 0
            for i, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.append((i, *one(value.as_py())))
                size += len(rows[-1][1]) if ddl != RESULT else 1
                if size >= SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("value")).mapInArrow(run, ddl)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every row of ``docs``, the end id last; null and empty texts have only that.

    Rows that repeat an id or a text are rows like any other; other columns are not read; an empty
    table gives no rows.
    """

    def make(model: PieceModel):
        encoder = Encoder(model)
        return lambda value: ([*chain.from_iterable(encoder.segments(value or "")), model.end_id],)

    return _per_row(docs, text, id_column, path, make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null and empty ids give the empty text, ids outside the
    vocabulary are an error."""

    def make(model: PieceModel):
        decoder = Decoder(model)
        return lambda ids: ("".join(decoder.texts([ids or []])),)

    return _per_row(encoded, "ids", "doc_id", path, make, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: number of ids with the end id, digest of the ids joined by blanks, digest of
    the text decoded from them. A very long text is worked on a segment at a time."""

    def make(model: PieceModel):
        encoder, decoder = Encoder(model), Decoder(model)
        decimal = [str(i) for i in range(len(model.pieces))]

        def one(value: str | None) -> tuple[int, str, str]:
            count, written, decoded = 0, hashlib.sha256(), hashlib.sha256()

            def parts() -> Iterator[list[int]]:
                nonlocal count
                for ids in chain(encoder.segments(value or ""), [[model.end_id]]):
                    written.update(((" " if count else "") + " ".join(map(decimal.__getitem__, ids))).encode())
                    count += len(ids)
                    yield ids

            for shown in decoder.texts(parts()):
                decoded.update(shown.encode())
            return count, written.hexdigest(), decoded.hexdigest()

        return one

    return _per_row(docs, text, id_column, path, make, RESULT)
