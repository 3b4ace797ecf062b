"""Whitening and hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import difference
from txrisk.llm import hard_negatives, oracle, queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def whole(rows, factor, offset=0):
    """The rows that count, as whole numbers."""
    good = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    x = np.floor(np.array([r[1] for r in good], np.float32).astype(float) * factor).astype(np.int64) + offset
    return good, x


def check_whitening(spark, rows, found=None):
    found = whitening.whitened_components(vectors(spark, rows)).collect() if found is None else found
    good, x = whole(rows, 1024, 100_000)
    n, width = x.shape
    sums = x.sum(axis=0)
    centred = (n * x - sums) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(found) == n * min(8, width)
    at = {r[0]: k for k, r in enumerate(good)}
    ours = np.zeros((n, min(8, width)))
    exact = ((n * x - sums).astype(object) ** 2).sum(axis=1)
    for r in found:
        k = at[r["vec_id"]]
        ours[k, r["component"] - 1] = np.nan if r["whitened"] is None else r["whitened"]
        assert r["n"] == n and r["deviation"] == exact[k] == int(r["deviation_exact"])
        share = max(values[r["component"] - 1], 0) / values.sum()
        assert r["explained"] == pytest.approx(share, rel=1e-6, abs=1e-12)
    return ours, centred, values, axes, found


def same_up_to_sign(ours, centred, values, axes, count):
    theirs = centred @ axes[:, :count] / np.sqrt(values[:count])
    signs = np.sign((ours[:, :count] * theirs).sum(axis=0))
    assert np.abs(ours[:, :count] - theirs * signs).max() < 1e-8


def test_whitening_is_that_of_the_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)) @ np.diag(2.0 ** -np.arange(12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 11, 1), (902, [math.nan] + [0.0] * 11, None), (903, [math.inf] * 12, 1)]
    ours, centred, values, axes, found = check_whitening(spark, rows)
    same_up_to_sign(ours, centred, values, axes, 8)
    assert found[0]["identity_error"] < 1e-9


def test_directions_without_variance(spark):
    """A constant dimension, a repeated one, and fewer rows than dimensions."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(5):
        a, b, c = rng.integers(-500, 500, 3) / 1024
        rows.append((k, [float(v) for v in (a, a, 0.5, b, c, b, 0.25, 0.0, 1.0)], 0))
    ours, centred, values, axes, found = check_whitening(spark, rows)
    same_up_to_sign(ours, centred, values, axes, 3)
    assert np.isnan(ours[:, 3:]).all() and found[0]["identity_error"] < 1e-9
    assert all(r["explained"] == 0 for r in found if r["component"] > 3)


def test_nearly_dependent_dimensions(spark):
    """Columns that differ in the last unit only: the covariance's condition is some 10^11."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        a = int(rng.integers(-500_000, 500_000))
        rows.append((k, [a / 1024, (a + int(k % 7 == 0)) / 1024, (a + int(k % 5 == 0)) / 1024], 0))
    ours, centred, values, axes, found = check_whitening(spark, rows)
    assert np.abs(ours.T @ ours / 400 - np.eye(3)).max() < 1e-5
    assert found[0]["identity_error"] < 1e-4


def test_whitening_of_few_rows(spark):
    assert whitening.whitened_components(vectors(spark, [])).collect() == []
    assert whitening.whitened_components(vectors(spark, [(1, None, 0)])).collect() == []
    same = whitening.whitened_components(vectors(spark, [(1, [0.5, 1.0], 0), (1, [0.5, 1.0], 0), (None, [0.5, 1.0], 0)])).collect()
    assert len(same) == 6
    assert all((r["whitened"], r["explained"], r["identity_error"], r["deviation"]) == (None, None, None, 0) for r in same)


def test_whitening_reads_its_columns_only(spark):
    df = vectors(spark, [(k, [k / 4, (k * k % 5) / 4], 0) for k in range(6)]).withColumns(
        {c: F.lit(c) for c in ("x", "n", "place", "component", "whitened", "deviation")}
    )
    assert whitening.whitened_components(df).count() == 12


def test_vectors_of_several_lengths_are_refused(spark):
    with pytest.raises(Exception, match="lengths|entries in one column"):
        whitening.fit(vectors(spark, [(1, [0.5], 0), (2, [0.5, 1.0], 0)]).coalesce(1))


def test_exact_deviations_beyond_a_long():
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 39), 1 << 39, (5, 3))
    n, sums = 10**9, tuple(int(s) for s in rng.integers(-(1 << 60), 1 << 60, 3))
    plain = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums) == plain


def test_op11(spark, sf_dir):
    """The query over its whole table."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = queries.op11_whitening(spark, sf_dir).collect()
    ours, centred, values, axes, found = check_whitening(spark, rows, found)
    same_up_to_sign(ours, centred, values, axes, 8)


def plain_negatives(rows, step):
    good, x = whole([r for r in rows if r[0] is not None and r[2] is not None], 256)
    out = []
    for k, a in enumerate(good):
        if a[0] % step:
            continue
        score = [int(s) for s in x @ x[k]] if len(x) else []
        order = sorted(range(len(good)), key=lambda j: (-score[j], good[j][0]))
        near = [j for j in order if good[j][2] == a[2] and good[j][0] != a[0]][:5]
        for p in near:
            fits = [j for j in order if good[j][2] != a[2] and 80 * score[p] <= 100 * score[j] <= 100 * score[p]]
            out += [(a[0], good[p][0], i, good[j][0], score[p], score[j]) for i, j in enumerate(fits[:5], 1)]
    return sorted(out)


def mined(df, step=100):
    found = hard_negatives.hard_negatives(hard_negatives.prepared(df, F.col("label")), F.col("vec_id") % step == 0)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 16), (3, 7)])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, seed, block):
    """Many ties: few different entries, and copies of vectors under other ids."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "FIRST_DEPTH", 2)
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(240):
        v = rows[int(rng.integers(k))][1] if k and rng.random() < 0.3 else (rng.integers(-3, 6, 5) / 8).tolist()
        rows.append((k, v, int(rng.integers(3))))
    rows += [(400, None, 1), (500, [0.5] * 5, None), (600, [None] * 5, 1), (700, [math.nan] * 5, 1), (None, [0.5] * 5, 1)]
    assert mined(vectors(spark, rows), 10) == plain_negatives(rows, 10)


def test_hard_negatives_stop_early(spark):
    """Reading stops before the end where few rows are near, and finds the same."""
    rng = np.random.default_rng(5)
    x = np.zeros((3000, 4), np.int64)
    x[:, 0] = np.sort(rng.integers(0, 100_000, 3000))
    x[:, 1:] = rng.integers(-3, 3, (3000, 3))
    block = hard_negatives.Block(np.arange(3000), np.zeros(3000, np.int64), x)
    anchor = np.array([50, 1, -1, 0])
    reads = list(block.reads(anchor))
    assert sum(len(new) for new, _ in reads) == 3000
    [(rows, scores)] = block.best(anchor, np.ones(3000, bool), [hard_negatives.ANY], 5)
    plain = x @ anchor
    first = np.lexsort((np.arange(3000), -plain))[:5]
    assert rows.tolist() == first.tolist() and scores.tolist() == plain[first].tolist()
    taken = []
    real = block.scores
    block.scores = lambda r, a: taken.append(len(r)) or real(r, a)
    block.best(anchor, np.ones(3000, bool), [hard_negatives.ANY], 5)
    assert sum(taken) < 1500


def test_hard_negatives_of_odd_tables(spark):
    assert mined(vectors(spark, [])) == []
    assert mined(vectors(spark, [(0, [1.0], 1)])) == []
    zeros = [(k, [0.0, 0.0], k % 2) for k in range(12)]
    assert mined(vectors(spark, zeros)) == plain_negatives(zeros, 100)
    away = [(k, [1.0 if k == 0 else -1.0], k % 2) for k in range(8)]
    assert mined(vectors(spark, away)) == [] == plain_negatives(away, 100)
    extra = vectors(spark, zeros).withColumns({c: F.lit(c) for c in ("x", "anchor", "window", "rank", "score", "pack")})
    assert mined(extra) == plain_negatives(zeros, 100)


def test_op13(spark, sf_dir):
    assert difference(queries.op13_hard_negatives(spark, sf_dir), sf_dir, oracle.OP13) is None
