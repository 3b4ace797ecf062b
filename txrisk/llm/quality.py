"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed towards a normal shape. Each class gets its mean and a
covariance shrunk towards the pooled variances; scores are differences of log densities, whose
Mahalanobis distances use Cholesky factors computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.frames import store

#: Weight of the pooled variances in a class covariance, and the least variance.
SHRINKAGE = 0.1
FLOOR = 1e-4
THRESHOLD = 0.7

STATISTICS = (
    "words symbols upper punctuation digits word_length variety top_word line_breaks long_words"
).split()

_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower and beyond ASCII, 3 digit, 4 blank, 5 punctuation, 6 symbol
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3
_KIND[[32, 9, 10, 11, 12, 13]] = 4
_KIND[list(b",.;:?'\"-()")] = 5
_KIND[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 6


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one text; null counts as empty."""
    text = text or b""
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=7)
    size, words = max(1, len(text)), text.split()
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = [  # of a little more than there is, so that a few words are not taken for a pattern
        kinds[6] / (size + 50),
        kinds[1] / (kinds[1] + kinds[2] + 50),
        kinds[5] / (size + 50),
        kinds[3] / (size + 50),
        max(counts.values(), default=0) / (n + 20),
        len(lines) / (n + 20),
        sum(1 for w in words if len(w) > 20) / (n + 20),
    ]
    symbols, upper, punctuation, digits, top, breaks, long = np.sqrt(np.maximum(shares, 0)).tolist()
    length = float(np.log1p((len(text) - n) / max(1, n)))
    variety = float(np.log1p(len(counts)) / np.log1p(n)) if n else 1.0
    return [float(np.log1p(n)), symbols, upper, punctuation, digits, length, variety, top, breaks, long]


def document_statistics(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, x): the statistics of every row's whole text."""

    def read(batches):
        for b in batches:
            x = [statistics(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "text_hash", "x"]
            )

    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).cast("binary").alias("text"),
    )
    return source.mapInArrow(read, "doc_id long, text_hash long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Per class (0, 1): log prior less half the log determinant, mean, inverse Cholesky factor."""

    offset: np.ndarray
    mean: np.ndarray
    factor: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for every row."""
        log = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.factor[k].T
            log.append(self.offset[k] - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(statistics_of: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Model | float:
    """A model from all rows of ``labels`` (doc_id, label 0 or 1) that have statistics.

    Sums and sums of products are added up in Spark; the driver gets a few hundred numbers. With no
    row of one class there is no model: then the share of label 1, smoothed; 1.0 without any label.
    """
    d = len(STATISTICS)

    def moments(batches):
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False)
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, d)
            for k in (0, 1):
                own = x[label == k]
                if len(own):
                    values = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)],
                        ["label", "at", "value"],
                    )

    known = labels.filter("label IN (0, 1)").select("doc_id", F.col("label").cast("int"))
    rows = known.join(statistics_of, "doc_id").select("label", "x")
    sums = rows.mapInArrow(moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("v"))
    table = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # 2 * (1 + d + d * d) numbers
        table[r["label"], r["at"]] = r["v"]
    n = table[:, 0]
    if n.min() < 1:
        return float((n[1] + 1) / (n.sum() + 2)) if n.sum() else 1.0
    mean = table[:, 1 : 1 + d] / n[:, None]
    second = table[:, 1 + d :].reshape(2, d, d) / n[:, None, None]
    own = second - mean[:, :, None] * mean[:, None, :]
    pooled = np.diag(np.diag((own * n[:, None, None]).sum(axis=0) / n.sum()))
    cov = (1 - shrinkage) * own + shrinkage * pooled + FLOOR * np.eye(d)
    lower = np.linalg.cholesky(cov)
    factor = np.linalg.inv(lower)
    offset = np.log(n / n.sum()) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
    return Model(offset, mean, factor)


def score(statistics_of: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, text_hash, score) of every row."""

    def read(batches):
        for b in batches:
            if isinstance(model, float):
                s = np.full(b.num_rows, model)
            else:
                s = model.scores(np.array(b.column(2).to_pylist(), float).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["doc_id", "text_hash", "score"])

    return statistics_of.mapInArrow(read, "doc_id long, text_hash long, score double")


def training_row(id_column: str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id as text is not 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def _fitted(docs: DataFrame, labels: DataFrame, text: str, id_column: str) -> tuple[DataFrame, Model | float]:
    """The stored statistics of ``docs`` and the model of those whose labels may be learned."""
    found = store(document_statistics(docs, text, id_column), "statistics")
    learned = labels.filter(training_row("doc_id")).select("doc_id", F.col("quality").alias("label"))
    return found, fit(found, learned)


def _rejected(text: Column, model: Model | float, threshold: float) -> Column:
    """Whether the classifier rejects a text, judged where its row is."""

    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        if isinstance(model, float):
            s = np.full(len(texts), model)
        else:
            s = model.scores(np.array([statistics(t) for t in texts.to_pylist()], float).reshape(-1, len(STATISTICS)))
        return pa.array(s < threshold)

    return judge(text.cast("binary"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, text_hash.

    ``labels`` has doc_id and quality; null labels and rows without a document teach nothing, rows
    that repeat an id count each. Null and empty texts have the statistics of the empty text and a
    score like any other. Language, source and ids never enter a score. An empty table gives no rows.
    """
    found, model = _fitted(docs, labels, text, id_column)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return score(found, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash"
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; the columns as they are, whatever their names.
    Rows of one id and text go or stay together; an empty table gives no rows."""
    _, model = _fitted(docs, labels, text, id_column)
    # No join with the scores: it would shuffle every text to drop a few.
    return docs.filter(~_rejected(F.col(f"`{text}`"), model, threshold))
