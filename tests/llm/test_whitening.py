from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def dense(x):
    """The contract by whole matrices: covariance, all eigenvectors, exact deviations."""
    n, total = len(x), x.sum(axis=0)
    off = n * x.astype(object) - total
    centred = off.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return values[::-1], vectors[:, ::-1], centred, [int(s) for s in (off**2).sum(axis=1)]


@pytest.mark.parametrize("d,n,seed", [(40, 300, 2), (5, 60, 3)])
def test_whitening_equals_the_dense_decomposition(spark, d, n, seed):
    rng = np.random.default_rng(seed)
    v = (rng.standard_normal((n, d)) * rng.uniform(0.05, 0.3, d)).astype(np.float32)
    rows = [(k, [float(a) for a in r], 0, "x") for k, r in enumerate(v)]
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    x = np.floor(1024 * v.astype(float)).astype(np.int64) + 100_000
    values, vectors, centred, deviations = dense(x)
    k = min(8, d, n - 1)
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    white = np.zeros((n, k))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviations[r.vec_id]
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    np.testing.assert_allclose(white * np.sign((white * want).sum(axis=0)), want, atol=1e-9)
    cov = (white - white.mean(axis=0)).T @ (white - white.mean(axis=0)) / n
    assert abs(got[0].identity_error - np.abs(cov - np.eye(k)).max()) < 1e-12 and got[0].identity_error < 1e-9


def test_odd_rows(spark):
    good = [(n, [float(n % 3), float(n % 5)], 0, "x") for n in range(30)] + [(4, [1.0, 4.0], 0, "x"), (None, [0.0, 1.0], 0, "x")]
    odd = [(90, None, 0, "x"), (91, [], 0, "x"), (92, [1.0, None], 0, "x"), (93, [float("nan"), 1.0], 0, "x"), (94, [float("inf"), 1.0], 0, "x")]
    other = [(n, [float(n), float(n * n), 1.0], 0, "x") for n in range(50, 54)]  # the third dimension is constant
    got = wh.whiten(spark.createDataFrame(good + odd + other, SCHEMA)).collect()
    assert sorted({(r.n, r.component) for r in got}) == [(4, 1), (4, 2), (32, 1), (32, 2)]
    assert sum(r.n == 32 for r in got) == 64 and {r.vec_id for r in got if r.n == 4} == {50, 51, 52, 53}
    assert wh.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "x")], SCHEMA)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "x")] * 3, SCHEMA)).count() == 0


def test_entries_of_any_size(spark):
    rows = [(n, [3e38 if n == 0 else float(n), 0.25], 0, "x") for n in range(5)]
    got = {r.vec_id: r for r in wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 5 and got[0].deviation is None and got[0].component == 1
    big = [(n, [1e9 * n], 0, "x") for n in range(5)]
    x = [min(int(1024 * Fraction(float(np.float32(1e9 * n)))) // 1, 1 << 52) + 100_000 for n in range(5)]
    for r in wh.whiten(spark.createDataFrame(big, SCHEMA)).collect():
        want = (5 * x[r.vec_id] - sum(x)) ** 2
        assert r.deviation == (want if want < 1 << 63 else None)


def test_leading_with_equal_values():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    spectrum = np.array([5.0] * 3 + [4.0] * 10 + [1.0] * 47)
    values, vectors = wh.leading(lambda y: q @ (spectrum[:, None] * (q.T @ y)), 60, 8)
    np.testing.assert_allclose(values, spectrum[:8], rtol=1e-12)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
