"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text knows every substring of it. A new text is parsed against each
language's automaton into phrases, each the longest match from where the last one ended. The language
that needs the fewest phrases, normalised by the logarithm of its training length, wins. Texts are
parsed in segments of ``SEGMENT`` letters, all segments of a batch in step; a phrase ends with its
segment, and every segment of the whole text counts. A letter that a language does not have opens the
phrase of the match behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txrisk.llm.frames import store

#: Bounds of the training sample: rows of a language, letters of a language and of all together.
SAMPLE_ROWS = 200
SAMPLE_CHARS = 30_000
TOTAL_CHARS = 240_000
#: Rows with so many characters are taken first, so that one long text is not the whole sample.
GOOD_LENGTH = (200, 5000)
SEGMENT = 512
#: The most entries of a table of transitions.
DENSE = 16 << 20
#: About so many letters are parsed in step.
LETTERS_AT_ONCE = 4_000_000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    """Lower-case letters, every run of other characters as one space; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return points[:0]
    before = np.concatenate([[False], letter[:-1]])
    return np.where(letter, points, 32)[letter | before]


@dataclass(frozen=True)
class Transitions:
    """The transitions of an automaton: for each (state, symbol) the next state, 0 if there is none.

    With few symbols they are a table; else, as for languages with thousands of letters, the sorted
    numbers ``state * symbols + symbol`` of those there are, and their states. ``root`` is state 0's row.
    """

    symbols: int
    root: np.ndarray
    table: np.ndarray | None
    keys: np.ndarray | None = None
    states: np.ndarray | None = None

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state * self.symbols + symbol
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.states[at], 0)


def automaton(codes: list[int], symbols: int, dense: int | None = None) -> Transitions:
    """The suffix automaton of a text; as a table if that has at most ``dense`` entries."""
    size = 2 * len(codes) + 2
    go: list[dict[int, int]] = [{} for _ in range(size)]
    link, length = [-1] + [0] * (size - 1), [0] * size
    last, states = 0, 1
    for c in codes:
        new, states = states, states + 1
        length[new] = length[last] + 1
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone, states = states, states + 1
                length[clone] = length[p] + 1
                go[clone] = dict(go[q])
                link[clone] = link[q]
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    keys = np.array([s * symbols + c for s in range(states) for c in sorted(go[s])], np.int64)
    to = np.array([go[s][c] for s in range(states) for c in sorted(go[s])], np.int32)
    root = np.zeros(symbols, np.int64)
    root[list(go[0])] = list(go[0].values())
    if states * symbols > (DENSE if dense is None else dense) and len(keys):
        return Transitions(symbols, root, None, keys, to)
    table = np.zeros(states * symbols, np.int32)
    table[keys] = to
    return Transitions(symbols, root, table)


def train(docs: DataFrame) -> dict | None:
    """A model from labelled rows (text, lang): a documented, bounded sample of whole texts.

    Of each language the rows of good length with the smallest hashes are read until their letters
    reach the bound. Null texts and languages teach nothing; without any there is no model.
    """
    low, high = GOOD_LENGTH
    size = F.length("text")
    keyed = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.sha2("text", 256).alias("text_key"))
    narrow = keyed.select("lang", "text_key", (~size.between(low, high)).alias("odd"))
    # First the best of each of 256 parts of a language, then of 16, then of all: no task meets more
    # than its part's share of the keys, or the best of 16 parts.
    chosen = narrow.distinct()
    for digits in (2, 1, 0):
        order = Window.partitionBy("lang", F.substring("text_key", 1, digits)).orderBy("odd", "text_key")
        chosen = chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_ROWS)
    chosen = store(chosen, "sample")
    # SAMPLE_ROWS rows a language: a fixed bound for the broadcast and for what the driver gets.
    rows = (
        keyed.join(F.broadcast(chosen.select("lang", "text_key", "rank")), ["lang", "text_key"])
        .dropDuplicates(["lang", "text_key"])
        .select("lang", "rank", "text")
    )
    texts: dict[str, dict[int, str]] = {}
    for r in rows.toLocalIterator():
        texts.setdefault(r["lang"], {})[r["rank"]] = r["text"]
    if not texts:
        return None
    bound = max(1, min(SAMPLE_CHARS, TOTAL_CHARS // len(texts)))
    points = {}
    for lang in sorted(texts):
        parts, total = [], 0
        for k in sorted(texts[lang]):
            if total < bound:
                part = np.append(code_points(texts[lang][k]), 32)
                parts.append(part[: 2 * bound])
                total += len(part)
        points[lang] = np.concatenate(parts)
    alphabet = np.unique(np.concatenate(list(points.values())))
    tables = [automaton(np.searchsorted(alphabet, p).tolist(), len(alphabet) + 1) for p in points.values()]
    return {"langs": list(points), "alphabet": alphabet, "tables": tables, "sizes": [len(p) for p in points.values()]}


def phrases(codes: np.ndarray, sizes: np.ndarray, known: Transitions) -> np.ndarray:
    """Phrases of each text (``sizes`` codes each, one after another) against an automaton."""
    ends = np.cumsum(sizes)
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]]).astype(np.int64)
    at = (ends - sizes)[owner] + (np.arange(len(owner)) - first[owner]) * SEGMENT
    left = np.minimum(ends[owner] - at, SEGMENT)
    order = np.argsort(-left, kind="stable")
    at, owner, left = at[order], owner[order], left[order]
    alive = np.searchsorted(-left, -np.arange(1, SEGMENT + 1), side="right")
    state = np.zeros(len(at), np.int64)
    count = np.ones(len(at), np.int64)
    for step in range(int(left[0]) if len(left) else 0):
        n = int(alive[step])
        symbol = codes[at[:n] + step]
        nxt = known.next(state[:n], symbol)
        stop = np.flatnonzero(nxt == 0)
        if step:
            count[stop] += 1
        nxt[stop] = known.root[symbol[stop]]
        state[:n] = nxt
    return np.bincount(owner, weights=count, minlength=len(sizes))


def predict(texts: list[str | None], model: dict | None) -> tuple[list[str], list[float]]:
    points = [code_points(t) if t and model else np.zeros(0, np.uint32) for t in texts]
    sizes = np.fromiter(map(len, points), np.int64, len(points))
    if not sizes.any():
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    alphabet = model["alphabet"]
    flat = np.concatenate(points)
    codes = np.searchsorted(alphabet, flat)
    codes[codes == len(alphabet)] = 0
    codes = np.where(alphabet[codes] == flat, codes, len(alphabet))
    rates = np.array(
        [phrases(codes, sizes, t) * np.log2(n + 1) for t, n in zip(model["tables"], model["sizes"], strict=True)]
    )
    best = rates.argmin(axis=0)
    ordered = np.sort(rates, axis=0)
    sure = ordered[1] / np.maximum(ordered[0] + ordered[1], 1e-9) if len(rates) > 1 else np.ones(len(sizes))
    return (
        [model["langs"][k] if n else UNKNOWN for k, n in zip(best.tolist(), sizes.tolist(), strict=True)],
        np.where(sizes > 0, sure, 0.0).tolist(),
    )


def languages(docs: DataFrame, labelled: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, learned from ``labelled`` (text, lang).

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null, has no letter or
    nothing was learned. The score is the runner-up's share of the two smallest normalised phrase
    counts, 0.5 to 1; ties go to the first language by name. Rows that repeat are rows like any other, and
    an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled))

    def read(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            edges = np.cumsum([len(t or "") for t in texts]) // LETTERS_AT_ONCE
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(edges)) + 1):
                lang, sure = predict([texts[k] for k in part.tolist()], model.value)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(part)), pa.array(lang, pa.string()), pa.array(sure, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(read, "doc_id long, lang_pred string, score double")
