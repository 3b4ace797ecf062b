"""Whitening of embeddings by shifted CholeskyQR.

Entries are whole numbers, so their sums, and ``n`` times each row less the sums, are exact: rows are
centred without cancellation. Every pass over the rows takes the Gram matrix of the centred rows after
triangular solves with the factors found so far; its Cholesky factor, of the matrix plus a small shift
as long as it is far from the identity, is the next one. When the rows have become orthonormal, the
product of the factors is R of the centred rows, and its singular values and right vectors are the
standard deviations and components of the covariance, as accurate as double numbers are, though no
covariance matrix is ever decomposed.

A task gives out the sums of its rows only: one row for every row and block of columns of the Gram
matrix, added up by Spark. The driver gets matrices of the vectors' dimensions, however many rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.vectors import matrix, scaled, usable

FACTOR, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Columns of a Gram matrix that are added up in one row.
BLOCK = 32
#: Passes over the rows at most; rows of full rank need three.
PASSES = 8
#: How far from the identity a Gram matrix may be at the end, and what counts as no direction at all.
ORTHONORMAL, NOTHING = 1e-10, 1e-14
#: Rows that are worked on at once.
ROWS = 4096

WHITENED = "vec_id long, deviation decimal(38,0), whitened array<double>"


@dataclass(frozen=True)
class Whitening:
    """What was fitted: number of rows, exact sums, components (columns, by falling eigenvalue), their
    eigenvalues, the trace of the covariance, and how far whitened rows are from the identity."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None
    passes: int = 0

    @property
    def rank(self) -> int:
        """Components of a positive eigenvalue."""
        return int((self.eigenvalues > 0).sum())


def _rows_of(df: DataFrame, vector: str, factor: int, offset: int) -> DataFrame:
    return df.filter(usable(vector)).select(scaled(df, vector, factor, offset).alias("x"))


def _sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sum per dimension."""

    def run(batches):
        total, width, n = None, None, 0
        for b in batches:
            x = matrix(b.column(0), width)
            width = x.shape[1] if width is None and len(x) else width
            for k in range(0, len(x), ROWS):
                part = [int(v) for v in x[k : k + ROWS].sum(axis=0)]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            n += len(x)
        if n:
            dims = pa.array(range(width), pa.int32())
            values = pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([dims, pa.array([n] * width, pa.int64()), values], ["dim", "n", "total"])

    per_task = rows.mapInArrow(run, "dim int, n long, total decimal(38,0)")
    summed = per_task.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    found = summed.orderBy("dim").collect()  # one row per dimension
    if found and len({r["n"] for r in found}) > 1:
        raise ValueError("vectors of several lengths in one column")
    return (found[0]["n"] if found else 0), tuple(int(r["total"]) for r in found)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - S / n`` with one rounding: the whole part of the mean is taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangular factor in turn, by substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _gram(rows: DataFrame, width: int, make) -> np.ndarray:
    """The sum over all tasks of the ``width`` x ``width`` matrix that ``make(parts)`` gives for a task's
    matrices of rows."""
    blocks = -(-width // BLOCK)

    def run(batches):
        whole = make(matrix(b.column(0))[k : k + ROWS] for b in batches for k in range(0, b.num_rows, ROWS))
        if whole is None:
            return
        padded = np.zeros((width, blocks * BLOCK))
        padded[:, :width] = whole
        flat = padded.reshape(width * blocks, BLOCK)
        place = pa.array(np.arange(width * blocks, dtype=np.int32))
        values = [pa.array(flat[:, k]) for k in range(BLOCK)]
        yield pa.RecordBatch.from_arrays([place, *values], ["place", *names])

    names = [f"v{k}" for k in range(BLOCK)]
    per_task = rows.mapInArrow(run, "place int, " + ", ".join(f"{n} double" for n in names))
    found = per_task.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out = np.zeros((width * blocks, BLOCK))
    for r in found:
        out[r["place"]] = [r[n] for n in names]
    return out.reshape(width, blocks * BLOCK)[:, :width]


def _upper(gram: np.ndarray) -> np.ndarray | None:
    try:
        return np.linalg.cholesky(gram).T
    except np.linalg.LinAlgError:
        return None


def _settled(gram: np.ndarray) -> bool:
    """Whether each direction is of unit length or not there at all."""
    values = np.linalg.eigvalsh(gram)
    return bool(np.all((np.abs(values - 1) < ORTHONORMAL) | (np.abs(values) < NOTHING)))


def fit(
    vectors: DataFrame, vector: str = "embedding", factor: int = FACTOR, offset: int = OFFSET, components: int = COMPONENTS
) -> Whitening | None:
    """Components of all usable vectors (no null or non-finite entry) of the frame; None without any.

    Vectors that repeat count each time. Fewer rows than dimensions, constant or repeated dimensions
    are allowed: directions without variance have the eigenvalue 0. Vectors of several lengths and
    entries beyond 2**40 after scaling are errors. The driver holds dimensions squared numbers.
    """
    rows = _rows_of(vectors, vector, factor, offset)
    n, sums = _sums(rows)
    width = len(sums)
    if not n:
        return None

    factors: list[np.ndarray] = []
    product = np.eye(width)
    for done in range(1, PASSES + 1):

        def gram_of(parts, factors=tuple(factors)):
            total = None
            for x in parts:
                q = solved(centred(x, n, sums), list(factors))
                total = q.T @ q if total is None else total + q.T @ q
            return total

        gram = _gram(rows, width, gram_of)
        gram = (gram + gram.T) / 2
        if not gram.any():  # all rows are equal
            break
        if len(factors) > 1 and _settled(gram):
            break
        # Rounding errors of a Gram matrix are below this shift, so that it has a Cholesky factor.
        shift = 11 * (n * width + width * (width + 1)) * np.finfo(float).eps * np.linalg.norm(gram, 2)
        near = factors and np.linalg.eigvalsh(gram)[0] > 0.1
        r = _upper(gram) if near else None
        if r is None:
            r = _upper(gram + min(shift, np.linalg.norm(gram, 2)) * np.eye(width))
        factors.append(r)
        product = r @ product
    # The last Gram matrix is that of the rows after all factors; its root brings R to full accuracy.
    values, axes = np.linalg.eigh(gram)
    _, lengths, right = np.linalg.svd((np.sqrt(np.maximum(values, 0))[:, None] * axes.T) @ product)
    eigenvalues = np.where(lengths > width * np.finfo(float).eps * lengths.max(initial=0.0), lengths, 0.0) ** 2 / n
    kept = min(components, width)
    model = Whitening(n, sums, right[:kept].T.copy(), eigenvalues[:kept], float(eigenvalues.sum()), None, done)
    return Whitening(**{**model.__dict__, "identity_error": _identity_error(rows, model)})


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.components[:, : model.rank] / np.sqrt(model.eigenvalues[: model.rank])


def _identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of whitened rows' covariance minus the identity."""
    k = model.rank
    if not k:
        return None

    def sums_of(parts):
        total = np.zeros((k + 1, k + 1))
        seen = False
        for x in parts:
            w = np.hstack([_whitened(x, model), np.ones((len(x), 1))])
            total += w.T @ w
            seen = True
        return total if seen else None

    total = _gram(rows, k + 1, sums_of)
    mean = total[:k, k] / model.n  # of centred rows, so all but 0: nothing cancels
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Per row the exact sum over dimensions of ``(n x - S) ** 2``."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    c = x - whole
    largest = int(np.abs(c).max(initial=0))
    if largest * max(largest, n) * len(sums) < 1 << 62:
        squares, products = (c * c).sum(axis=1).tolist(), (c @ np.array(rest, np.int64)).tolist()
    else:
        exact = c.astype(object)
        squares, products = (exact * exact).sum(axis=1).tolist(), (exact @ np.array(rest, object)).tolist()
    last = sum(r * r for r in rest)
    return [int(n * n * a - 2 * n * b + last) for a, b in zip(squares, products, strict=True)]


def transform(
    vectors: DataFrame,
    model: Whitening | None,
    vector: str = "embedding",
    id_column: str = "vec_id",
    factor: int = FACTOR,
    offset: int = OFFSET,
) -> DataFrame:
    """(vec_id, deviation, whitened) of every usable vector, rows that repeat and null ids too.

    ``deviation`` is the exact sum over dimensions of ``(n x - S) ** 2``. ``whitened`` has a value for
    each component; one without variance is null. Other columns are not read; an empty table, and a
    model of no rows, give no rows.
    """

    def run(batches):
        for b in batches:
            x = matrix(b.column(1), len(model.sums))
            for k in range(0, len(x), ROWS):
                part = x[k : k + ROWS]
                w = _whitened(part, model)
                missing = [None] * (len(model.eigenvalues) - model.rank)
                values = [[*row, *missing] for row in w.tolist()]
                exact = [Decimal(d) for d in deviations(part, model.n, model.sums)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(k, len(part)),
                        pa.array(exact, pa.decimal128(38, 0)),
                        pa.array(values, pa.list_(pa.float64())),
                    ],
                    ["vec_id", "deviation", "whitened"],
                )

    kept = vectors.filter(usable(vector)) if model else vectors.limit(0)
    source = kept.select(F.col(id_column).cast("long").alias("vec_id"), scaled(vectors, vector, factor, offset).alias("x"))
    return source.mapInArrow(run, WHITENED)


def whitened_components(vectors: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened,
    explained (share of the trace), identity_error, and deviation_exact.

    ``deviation`` is null where it is beyond a long; ``deviation_exact`` has it always. Components without
    variance have a null ``whitened`` and explain 0, or null if nothing varies.
    """
    model = fit(vectors, vector)
    rows = transform(vectors, model, vector, id_column)
    n, trace = (model.n, model.trace) if model else (0, 0.0)
    shares = [e / trace if trace else None for e in model.eigenvalues.tolist()] if model else []
    table = F.array(*[F.lit(s).cast("double") for s in shares]) if shares else F.array().cast("array<double>")
    error = model.identity_error if model else None
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "value")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        F.col("value").alias("whitened"),
        F.element_at(table, F.col("place") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )
