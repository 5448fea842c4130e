import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import whitening


def plain(x, k=32):
    """Whitened rows, shares and deviations from the whole covariance matrix."""
    x = np.floor(64 * x.astype(np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    top = np.argsort(-values)[:k]
    values, vectors = values[top], vectors[:, top]
    firm = values > values[0] * 1e-12
    deviation = [sum(int(v) ** 2 for v in row) for row in (n * x - s)]
    return z @ (vectors / np.sqrt(np.where(firm, values, 1)))[:, firm], values[firm] / np.trace(z.T @ z / n), deviation


def gathered(spark, rows, schema="vec_id long, embedding array<float>, component int, n string"):
    out = whitening.whiten(spark.createDataFrame(rows, schema))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return out.orderBy("vec_id", "component").collect()


@pytest.mark.parametrize(("n", "d"), [(300, 64), (40, 64), (120, 10), (500, 90)])
def test_against_the_whole_covariance(spark, n, d):
    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, d)) * np.geomspace(3, 0.3, d) + rng.normal(size=d)
    odd = [(9000, None, 1, "a"), (9001, [None] + [1.0] * (d - 1), 1, "a"), (9002, [float("nan")] * d, 1, "a"), (9003, [float("inf")] * d, 1, "a"), (9004, [], 1, "a"), (9005, [1.0] * (d - 1), 1, "a"), (9006, [1e37] * d, 1, "a")]
    got = gathered(spark, [(i, v.tolist(), 7, "b") for i, v in enumerate(x)] + odd)
    w, shares, deviation = plain(x)
    k = len(shares)
    assert k == min(32, d, n - 1)
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [(i, j + 1, n, deviation[i]) for i in range(n) for j in range(k)]
    mine = np.array([r.whitened for r in got]).reshape(n, k)
    sign = np.sign((mine * w).sum(axis=0))
    assert np.abs(mine - w * sign).max() < 1e-6
    assert np.allclose([r.explained for r in got[:k]], shares, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert np.abs(mine.T @ mine / n - np.eye(k)).max() < 1e-9


def test_few_equal_and_no_vectors(spark):
    assert gathered(spark, []) == [] and gathered(spark, [(1, [1.0, 2.0], 1, "a")]) == []
    assert gathered(spark, [(i, [1.0, 2.0], 1, "a") for i in range(9)]) == []
    flat = gathered(spark, [(i % 4 if i % 4 else None, [float(i % 4), 1.0, 2.0 * (i % 4)], 1, "a") for i in range(8)])
    assert len(flat) == 8 and {r.component for r in flat} == {1} and flat[0].vec_id is None
    assert np.isclose(flat[0].explained, 1)


def test_equal_eigenvalues_wider_than_a_block(spark):
    x = np.concatenate([np.eye(60), -np.eye(60)]) * 4
    got = gathered(spark, [(i, v.tolist(), 1, "a") for i, v in enumerate(x)])
    w = np.array([r.whitened for r in got]).reshape(120, 32)
    assert np.abs(w.T @ w / 120 - np.eye(32)).max() < 1e-9 and got[0].identity_error < 1e-9
    assert np.allclose([r.explained for r in got], 1 / 60)


def test_restart_after_a_breakdown():
    """Two spaces that no product leaves: the second is only found by a random restart."""
    v = np.diag(np.repeat([5.0, 3.0, 2.0, 1.0], [50, 50, 60, 40]))
    values, vectors, passes, residual = whitening.lanczos(lambda q: v @ q, 200, 70)
    assert np.allclose(values, [5.0] * 50 + [3.0] * 20) and residual < 1e-12 and passes <= 4
    assert np.abs(vectors.T @ vectors - np.eye(70)).max() < 1e-12


def test_fewer_passes_than_dimensions_on_a_steep_spectrum():
    v = np.diag(2.0 ** -np.arange(400))
    values, _, passes, residual = whitening.lanczos(lambda q: v @ q, 400, 8)
    assert np.allclose(values, 2.0 ** -np.arange(8), rtol=1e-12) and residual <= 1e-13 and passes * 16 < 400


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [1e12 if i == 3 else 1.0, float(i)], 1, "a") for i in range(5)]
    got = {r.vec_id: r.deviation for r in gathered(spark, rows)}
    assert got[3] is None
    assert whitening.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, n string"), whitening.Staged(spark)).agg(F.count("*")).first()[0] == 5
