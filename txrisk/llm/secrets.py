"""Secret scans through nested encodings.

Every text is a worklist of layers, first the text itself. A layer is scanned for secrets; its runs of
percent escapes, Unicode escapes and base64 are unwrapped into new layers until there is nothing left to
unwrap. Runs are unwrapped to bytes: what is compressed anywhere in them is a layer too, and bytes that are
no UTF-8 are replaced. Base64 is decoded at all four offsets, so what is glued to it does not matter, and
over line breaks besides line by line. A layer that was seen at the same place of the text is not taken up
again, which ends cycles.

Each layer knows where its characters were in the layer around it, so what is found has the span of its own
characters in the text. Only compressed bytes have no places: what is found below them has the span of
the run that holds them. A text may be unwrapped into a stated multiple of its length, 32 MB at
least, compressed bytes included; what goes beyond is hostile, and such a row says that it is not complete.
"""

from __future__ import annotations

import ast
import binascii
import hashlib
import html
import re
import warnings
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in order, with their patterns, and the fewest characters of the group named.
KINDS = ("assign", "access", "hex")
PATTERNS = (
    (
        "assign",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.ASCII | re.IGNORECASE,
        ),
        2,
        6,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]{16,}"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)

ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}")
UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|x[0-9A-Fa-f]{1,6});")
NOT_BLANK = re.compile(r"\S+")
BYTES_LITERAL = re.compile(r"""b(['"])(?:[^\\]|\\.)*?\1""", re.DOTALL)
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 with nothing but line breaks, written as themselves or as escapes, and indentation in it.
BREAK = re.compile(r"[\x20\t]*(?:[\r\n]|\\[rn])(?:[\x20\t-\r]|\\[rn])*")
WRAPPED_RUN = re.compile(
    rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)+={{0,2}}"
)
#: The first bytes of gzip and zlib streams.
HEADS = re.compile(
    b"\x1f\x8b\x08|"
    + b"|".join(re.escape(bytes([a, b])) for a in range(8, 128, 16) for b in range(256) if (a * 256 + b) % 31 == 0 and not b & 32)
)
#: No secret, and no encoded run that holds one, is shorter than ``token=abcdef``.
LEAST = re.compile(r"[\t-\r\x20-~]{12}")

#: A percent escape, or any other characters.
PERCENT_PART = re.compile(r"(%[0-9A-Fa-f]{2})|%|[^%]")
#: What bytes that are no UTF-8 are decoded to first.
LONE = re.compile("[\udc80-\udcff]")
#: Characters and bytes that a text is unwrapped into at most: so many, or so many for each of its own.
LEAST_WORK, WORK_PER_CHARACTER = 32 << 20, 16
#: Bytes inflated in one step.
PART = 1 << 20

SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, complete boolean"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the secrets in one layer."""
    found = []
    for rank, (_, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end()))
    return found


class Budget:
    """Characters and bytes that a text may still be unwrapped into."""

    def __init__(self, text: str):
        self.left = max(LEAST_WORK, WORK_PER_CHARACTER * len(text))
        self.spent = False

    def take(self, size: int) -> None:
        self.left -= size
        self.spent = self.spent or self.left < 0


class Layer:
    """A text that was unwrapped from its parent. ``places`` gives, when first needed, where in the
    parent's text each character begins and ends: two arrays, or one span for all."""

    def __init__(self, text: str, parent: Layer | None = None, places: Callable | None = None):
        self.text, self.parent, self._places = text, parent, places

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the outermost text that a span of this one came from."""
        if self.parent is None:
            return start, end
        if callable(self._places):
            self._places = self._places()
        first, last = self._places
        if isinstance(first, int):
            return self.parent.source(first, last)
        return self.parent.source(int(first[start]), int(last[end - 1]))


def _shown(data: bytes) -> str:
    """The bytes as UTF-8, each byte that is none as one replacement character."""
    return LONE.sub("\ufffd", data.decode("utf-8", "surrogateescape"))


def _by_character(data: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of ``_shown(data)`` begin and end, from where its bytes do."""
    points = np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    size[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    end = np.cumsum(size) - 1
    return first[end - size + 1], last[end]


def _percent_places(run: str, at: int, data: bytes) -> Callable:
    def places():
        first, last = [], []
        for m in PERCENT_PART.finditer(run):
            count = 1 if m.group(1) else len(m.group().encode("utf-8", "surrogatepass"))
            first.extend([at + m.start()] * count)
            last.extend([at + m.end()] * count)
        return _by_character(data, np.array(first), np.array(last))

    return places


def _unescape(run: str, at: int) -> tuple[str, bytes, Callable]:
    """The run without escapes, its characters as single bytes, and where its characters were."""

    def one(m: re.Match) -> str:
        s = m.group()
        if s[0] == "&":
            return html.unescape(s)
        return chr(int(s[2:], 16))

    text = UNICODE.sub(one, run)
    # Pairs of surrogates stand for one character.
    whole = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    def places():
        first, last, after = [], [], 0
        for m in UNICODE.finditer(run):
            first.extend(range(at + after, at + m.start()))
            last.extend(range(at + after + 1, at + m.start() + 1))
            count = len(one(m))
            first.extend([at + m.start()] * count)
            last.extend([at + m.end()] * count)
            after = m.end()
        first.extend(range(at + after, at + len(run)))
        last.extend(range(at + after + 1, at + len(run) + 1))
        units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        high, low = (units >> 10 == 0xD800 >> 10), (units >> 10 == 0xDC00 >> 10)
        paired = np.flatnonzero(high[:-1] & low[1:])
        begin, end = np.array(first), np.array(last)
        end[paired] = end[paired + 1]
        return np.delete(begin, paired + 1), np.delete(end, paired + 1)

    return whole, text.encode("latin-1", "replace"), places


def _inflate(data: memoryview, budget: Budget) -> tuple[bytes, int]:
    """What the stream at the start of ``data`` holds, up to its end, its first error or the end of the
    budget, and the bytes it takes up: none if it has an error. Gzip members in a row are one stream."""
    out: list[bytes] = []
    d, at, step = zlib.decompressobj(47), 0, 65_536
    while at < len(data) and not budget.spent:
        before, part = d.copy(), data[at : at + step]
        try:
            out.append(d.decompress(part, PART))
        except zlib.error:
            # What comes before the error is found in ever smaller steps.
            if step == 1:
                return b"".join(out), 0
            d, step = before, max(1, step // 16)
            continue
        budget.take(len(out[-1]))
        at += len(part) - len(d.unconsumed_tail) - len(d.unused_data)
        if d.eof:
            if data[at : at + 2] != b"\x1f\x8b":
                break
            d = zlib.decompressobj(47)
    return b"".join(out), at


def _streams(data: bytes, budget: Budget) -> Iterator[bytes]:
    """The contents of the compressed streams in ``data``."""
    at = 0
    while (m := HEADS.search(data, at)) and not budget.spent:
        content, size = _inflate(memoryview(data)[m.start() :], budget)
        if content:
            yield content
        at = m.start() + (size or 1)


def _inner_streams(data: bytes, budget: Budget) -> Iterator[bytes]:
    """All that is compressed in ``data``, layer after layer."""
    work, seen = list(_streams(data, budget)), set()
    while work:
        content = work.pop()
        key = hashlib.sha256(content).digest()
        if key not in seen:
            seen.add(key)
            yield content
            work.extend(_streams(content, budget))


def _from_base64(run: str, at: int) -> Iterator[tuple[bytes, Callable]]:
    """The bytes of a run at each of the four offsets, and where their characters were."""
    breaks = [m.span() for m in BREAK.finditer(run)]
    body = BREAK.sub("", run) if breaks else run
    body = body.rstrip("=").replace("-", "+").replace("_", "/")
    for k in range(4):
        part = body[k:]
        if len(part) % 4 == 1:  # six bits are no byte
            part = part[:-1]
        data = binascii.a2b_base64(part + "=" * (-len(part) % 4))

        def places(k=k, data=data):
            kept = np.ones(len(run), bool)
            for i, j in breaks:
                kept[i:j] = False
            where = at + np.flatnonzero(kept)
            bit = 8 * np.arange(len(data))
            return _by_character(data, where[k + bit // 6], where[k + (bit + 7) // 6] + 1)

        yield data, places


def unwrapped(layer: Layer, budget: Budget) -> Iterator[tuple[int, int, Layer]]:
    """(start, end, content) of the encoded runs of a layer that may hold something."""
    text = layer.text

    def held(m: re.Match, content: str, places: Callable) -> Iterator[tuple[int, int, Layer]]:
        budget.take(len(content))
        if LEAST.search(content):
            yield m.start(), m.end(), Layer(content, layer, places)

    def compressed(m: re.Match, data: bytes) -> Iterator[tuple[int, int, Layer]]:
        # Compressed bytes have no place of their own in the text: the run's is that of all of them.
        for content in _inner_streams(data, budget):
            yield from held(m, _shown(content), m.span)

    if ESCAPED.search(text):
        for m in NOT_BLANK.finditer(text):
            run = m.group()
            if "%" in run and ESCAPED.search(run):
                data = unquote_to_bytes(run.encode("utf-8", "surrogatepass"))
                places = _percent_places(run, m.start(), data)
                yield from held(m, _shown(data), places)
                yield from compressed(m, data)
                if "+" in run:  # forms write a blank so
                    data = unquote_to_bytes(run.replace("+", " ").encode("utf-8", "surrogatepass"))
                    yield from held(m, _shown(data), _percent_places(run, m.start(), data))
    if UNICODE.search(text):
        for m in NOT_BLANK.finditer(text):
            if UNICODE.search(m.group()):
                content, data, places = _unescape(m.group(), m.start())
                yield from held(m, content, places)
                yield from compressed(m, data)
        for m in BYTES_LITERAL.finditer(text):
            if "\\x" in m.group():
                try:
                    with warnings.catch_warnings(action="ignore"):
                        data = ast.literal_eval(m.group())
                except (SyntaxError, ValueError):
                    continue
                yield from compressed(m, data)
    runs = [BASE64_RUN.finditer(text), (m for m in WRAPPED_RUN.finditer(text) if m.end() - m.start() > 16)]
    for m in chain.from_iterable(runs):
        for data, places in _from_base64(m.group(), m.start()):
            yield from held(m, _shown(data), places)
            yield from compressed(m, data)


Spans = list[tuple[int, int, int]]


def findings(text: str) -> tuple[Spans, Spans, int]:
    """Secrets of the text itself, all spans with those of its layers, and the number of layers."""
    return worked_off(text)[:3]


def worked_off(text: str) -> tuple[Spans, Spans, int, bool]:
    """What ``findings`` gives, and whether all layers were unwrapped within the budget."""
    base = sorted(scan(text))
    spans, seen, layers = set(base), set(), 0
    budget = Budget(text)
    work = [Layer(text)]
    while work:
        layer = work.pop()
        layers += 1
        if layer.parent:
            for start, rank, end in scan(layer.text):
                first, last = layer.source(start, end)
                spans.add((first, rank, last))
        for i, j, inner in unwrapped(layer, budget):
            if budget.spent:
                break
            if inner.text and inner.text != layer.text[i:j]:
                place = layer.source(i, j)
                key = (*place, hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                if key not in seen:
                    seen.add(key)
                    work.append(inner)
    return base, sorted(spans), layers, not budget.spent


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in spans)


def secret_spans(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: counts of secrets in the text itself, digest of their spans, all spans.

    Spans are ``kind:start:end`` in code points, by start, then kind; a secret below a compressed layer
    has the span of the run that holds it. ``n_layers`` counts the text and what was unwrapped;
    ``complete`` is false where the text unwraps into more than its budget. Null counts as empty and has
    none. Rows that repeat are rows like any other; other columns are not read; an empty table gives no rows.
    """

    def read(batches):
        names = [x.split()[0] for x in SPANS.split(", ")]
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.bool_()]
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, spans, layers, complete = worked_off(t or "")
                counts = [sum(1 for x in base if x[1] == k) for k in range(3)]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                out.append((i, *counts, digest, written(spans), layers, complete))
            part = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(part, kinds, strict=True)], names)

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(read, SPANS)
