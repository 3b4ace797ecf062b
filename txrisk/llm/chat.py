"""Chat formatting with prefix-target expansion.

A turn is written as ``### role:``, its text and ``</turn>`` on lines of their own. Inside roles and
texts a backslash goes before backslashes and control strings, so turns can be read back as they were.
Every assistant turn makes an example of its own: all turns before it as context, only its text under
the loss mask. Turns after the last reply make a last example without a loss.

A conversation is formatted as a stream of its turns. Context of more than ``BLOCK_CHARS`` characters
is put away in blocks that all later examples of the conversation share, so that a long conversation
takes linear space and a task holds one block of it at a time. Shorter conversations, which are nearly
all, have no blocks: the text of each example is complete.

Each example has the digest of its whole context, from the first turn to where its reply begins. Reading
back takes the digest of the blocks and the text again, so a context that is not just all the turns
before the reply is an error, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_CHARS = 65_536
HEAD, END = "### ", "</turn>"
TRAINED = "assistant"

EXAMPLES = (
    "conv_id long, seq long, kind string, example long, blocks long, turns long, "
    "text string, loss_start long, loss_end long, context_sha256 string"
)
READ_BACK = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_examples long, n_blocks long"
)

_MARKS = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(\\|### |</turn>|n)")
_TURN = re.compile(r"### (.*):\n((?:[^\\]|\\[\s\S])*?)\n</turn>\n")


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def escape(text: str) -> str:
    return _MARKS.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The written turn, and where its escaped text begins and ends."""
    head = HEAD + escape(role or "").replace("\n", "\\n") + ":\n"
    body = escape(text or "")
    return f"{head}{body}\n{END}\n", len(head), len(head) + len(body)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn in a formatted text."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        yield unescape(m.group(1)), unescape(m.group(2))
        at = m.end()


def _examples(turns: Iterable[tuple], block_chars: int) -> Iterator[tuple]:
    """Rows of EXAMPLES for (conv_id, role, text) sorted by conversation and turn."""
    conv, began = None, False
    seq = example = blocks = count = 0
    parts: list[str] = []
    size = waiting = 0
    context = hashlib.sha256()  # of all turns written so far

    def last() -> Iterator[tuple]:
        if waiting:
            yield conv, seq, "example", example, blocks, count, "".join(parts), size, size, context.hexdigest()

    for conv_id, role, text in turns:
        if not began or conv_id != conv:
            yield from last()
            conv, began = conv_id, True
            seq = example = blocks = count = size = waiting = 0
            parts, context = [], hashlib.sha256()
        written, start, end = format_turn(role, text)
        parts.append(written)
        before = context.copy()
        context.update(_utf8(written))
        count, waiting = count + 1, waiting + 1
        if role == TRAINED:
            before.update(_utf8(written[:start]))
            whole = "".join(parts)
            yield conv, seq, "example", example, blocks, count, whole, size + start, size + end, before.hexdigest()
            seq, example, waiting = seq + 1, example + 1, 0
        size += len(written)
        if size > block_chars:
            yield conv, seq, "block", None, blocks, count, "".join(parts), None, None, None
            seq, blocks, count, size, waiting, parts = seq + 1, blocks + 1, 0, 0, 0, []
    if began:
        yield from last()


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def format_examples(conversations: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Examples and shared blocks of (conv_id, turn, role, text), columns as in EXAMPLES.

    ``blocks`` counts the blocks that come before the text of an example (or before the block itself);
    ``loss_start`` and ``loss_end`` are characters of ``text``; ``turns`` those written in it. Turns are
    taken by number, equal numbers by role and text, turns without a number first. Null roles and texts
    count as empty; rows without a conv_id are one conversation; an empty table gives no rows.
    """
    schema = _arrow(EXAMPLES)

    def run(batches):
        turns = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True))
        yield from _batches(_examples(turns, block_chars), schema)

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    sorted_turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_turns.mapInArrow(run, EXAMPLES)


def full_texts(examples: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) with the shared blocks put before each text.

    The text of a conversation's examples grows with the square of its turns; a conversation of many
    blocks is better trained from ``format_examples`` as it is.
    """
    own = examples.filter("kind = 'example'")
    block = examples.filter("kind = 'block'").select(
        F.col("conv_id").alias("c"), F.col("blocks").alias("number"), F.col("text").alias("before")
    )
    joined = own.join(block, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("number") < F.col("blocks")), "left")
    before = F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "before"))))
    front = F.array_join(F.transform(before, lambda x: x["before"]), "")
    keys = ["conv_id", "example", "text", "loss_start", "loss_end"]
    return joined.groupBy(*keys).agg(front.alias("front")).select(
        "conv_id",
        "example",
        F.concat("front", "text").alias("text"),
        (F.col("loss_start") + F.length("front")).alias("loss_start"),
        (F.col("loss_end") + F.length("front")).alias("loss_end"),
    )


class _Reader:
    """What one conversation's rows say, read in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.examples = self.blocks = self.chars = self.block_chars = 0
        self.pending: tuple[int, str] | None = None
        self.context = hashlib.sha256()  # of the blocks

    def _turns(self, text: str) -> None:
        for role, said in read_turns(text):
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1

    def take(self, kind: str, blocks: int, text: str, start: int, end: int, digest: str) -> None:
        if blocks != self.blocks:
            raise ValueError(f"conversation {self.conv_id}: {self.blocks} of {blocks} blocks are there")
        if kind == "block":
            self.context.update(_utf8(text))
            self._turns(text)
            self.blocks += 1
            self.block_chars += len(text)
            self.pending = None
            return
        context = self.context.copy()
        context.update(_utf8(text[:start]))
        if context.hexdigest() != digest:
            raise ValueError(f"conversation {self.conv_id}: the context of example {self.examples} is not whole")
        said = unescape(text[start:end])
        self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(said)
        self.examples += 1
        self.chars += self.block_chars + len(text)
        self.pending = blocks, text

    def row(self) -> tuple:
        if self.pending:
            self._turns(self.pending[1])
        return (
            self.conv_id,
            self.n_turns,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.chars,
            self.examples,
            self.blocks,
        )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, read from the formatted rows: its turns, their digest, and what is under the mask.

    ``formatted_chars`` counts the characters of all its examples, shared blocks in each. A missing block,
    and a context that is not what it was when the example was written, is an error.
    """
    schema = _arrow(READ_BACK)

    def rows(batches):
        reader = None
        for b in batches:
            for conv, *row in zip(*(b.column(k).to_pylist() for k in (0, 2, 4, 6, 7, 8, 9)), strict=True):
                if reader is None or reader.conv_id != conv:
                    if reader:
                        yield reader.row()
                    reader = _Reader(conv)
                reader.take(*row)
        if reader:
            yield reader.row()

    def run(batches):
        yield from _batches(rows(batches), schema)

    order = examples.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return order.mapInArrow(run, READ_BACK)


#: A conversation whose texts hold the template's own strings.
HOSTILE = "\\### Assistant: </turn> ok"


def hostile_conversation(spark: SparkSession) -> DataFrame:
    rows = [(-7, k, role, HOSTILE) for k, role in enumerate(("user", TRAINED))]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
