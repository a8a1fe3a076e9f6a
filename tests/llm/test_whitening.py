"""Whitening against exact fractions and plain eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest

from rimeweave.llm.whitening import HIGH, covariance, fit_whitening, refined_eigenvectors, whitened_rows

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", "n") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rotated(values, seed=0):
    """A symmetric matrix with the given eigenvalues, in HIGH precision."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0].astype(HIGH)
    for _ in range(4):
        q = q + q @ (np.eye(len(values), dtype=HIGH) - q.T @ q) / 2
    return (q * np.array(values, HIGH)) @ q.T, q


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], list(range(40, 0, -1)), [3, 1 + 1e-6, 1, 1 - 1e-6, 0.5], [2, 1 + 3e-10, 1 + 1e-10, 1, 0.2],
    [1 + 2e-13, 1 + 1e-13, 1], [1e6, 1, 1e-3],
])
def test_refinement_separates_clusters(values):
    matrix, q = rotated(values)
    got, vectors = refined_eigenvectors(matrix)
    scale, size = max(values), len(values)
    assert np.abs(got - np.array(sorted(values, reverse=True), HIGH)).max() <= 1e-17 * scale * size
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-17 * size
    assert np.abs(matrix @ vectors - vectors * got).max() <= 2e-18 * scale * size**2
    gaps = min(abs(a - b) for a in values for b in values if a != b)
    turned = np.abs((vectors * q[:, np.argsort([-v for v in values])]).sum(axis=0))
    assert np.abs(turned - 1).max() < 1e-17 * size + (1e-17 * scale / gaps) ** 2 * 10


def test_equal_eigenvalues_keep_an_orthogonal_basis():
    matrix, _ = rotated([4, 2, 2, 2, 1])
    got, vectors = refined_eigenvectors(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-16 and np.abs(matrix @ vectors - vectors * got).max() < 1e-16
    assert (refined_eigenvectors(np.zeros((3, 3), HIGH))[0] == 0).all()


def exact(vectors):
    """Distinct grid vectors, sums and covariance in fractions."""
    fit = sorted({tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for v in vectors})
    n, size = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(size)]
    cov = [[sum((Fraction(x[i]) - Fraction(sums[i], n)) * (x[j] - Fraction(sums[j], n)) for x in fit) / n for j in range(size)] for i in range(size)]
    return fit, sums, cov


@pytest.mark.parametrize("shift", [0, 1000, 3e12])
def test_covariance_is_exact(spark, shift):
    draw = np.random.default_rng(2)
    vectors = (draw.normal(size=(60, 5)) * 3 + shift * np.array([1, 0, -1, 0, 1])).tolist()
    fit, sums, cov = exact(vectors)
    n, got_sums, got = covariance(spark.createDataFrame([(list(x),) for x in fit], "x array<long>").repartition(4))
    assert (n, got_sums) == (len(fit), sums)
    wanted = np.array([[HIGH(str(c.numerator)) / HIGH(str(c.denominator)) for c in row] for row in cov])
    assert np.abs(got - wanted).max() <= 1e-18 * np.abs(wanted).max()


def test_rows_against_fractions(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(200, 6)).tolist()
    vectors += vectors[:20] * 3
    df = table(spark, vectors)
    model = fit_whitening(df)
    fit, sums, cov = exact(vectors)
    values, columns = np.linalg.eigh(np.array(cov, float))
    rows = whitened_rows(df, model).collect()
    assert len(rows) == 4 * len(vectors) and model.n == len(fit) and model.identity_error < 1e-12
    signs = {}
    for row in rows:
        x = [int(np.floor(256 * float(np.float32(c)))) for c in vectors[row.vec_id]]
        y = [len(fit) * a - s for a, s in zip(x, sums)]
        k = -row.component
        wanted = np.dot(y, columns[:, k]) / len(fit) / values[k] ** 0.5
        sign = signs.setdefault(row.component, np.sign(wanted * row.whitened))
        assert row.deviation == sum(a * a for a in y) and row.n == len(fit)
        assert abs(sign * row.whitened - wanted) < 1e-9
        assert abs(row.explained - values[k] / values.sum()) < 1e-12


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 2], [1, 2], [3, 5], [4, 1], None, [1, None], [nan, 1], [1, inf], [-inf, 2], [], [1, 2, 3], [7]]
    df = table(spark, vectors, [1, 2, 3, None, 5, 6, 7, 8, 9, 10, 11, 12])
    model = fit_whitening(df)
    rows = whitened_rows(df, model).collect()
    assert model.n == 3 and sorted((r.vec_id or 0, r.component) for r in rows) == [(k, c) for k in (0, 1, 2, 3) for c in (1, 2)]
    assert all(r.whitened is not None for r in rows)


def test_no_variance_large_values_and_empty(spark):
    flat = table(spark, [[1, 2, 3]] * 4)
    rows = whitened_rows(flat, fit_whitening(flat)).collect()
    assert len(rows) == 12 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in rows)
    line = table(spark, [[k, 2 * k, 0] for k in range(5)])
    rows = whitened_rows(line, fit_whitening(line)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in rows) and all(r.identity_error < 1e-12 for r in rows)
    huge = table(spark, [[3e38, 1], [-3e38, 2], [1, 3]])
    rows = whitened_rows(huge, fit_whitening(huge)).collect()
    assert len(rows) == 6 and all(r.deviation is None for r in rows if r.vec_id < 2)
    none = table(spark, [None, []])
    assert whitened_rows(none, fit_whitening(none)).collect() == []
