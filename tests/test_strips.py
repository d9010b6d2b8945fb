"""More distinct points than a dense task holds: strips of rows and solves without stored entries equal numpy."""

import numpy as np
import pandas as pd
import pytest

from gaussmill.functions import kernels as K
from gaussmill.operators import covariance as C
from gaussmill.operators import matrix_free
from gaussmill.operators import strips as T


def symmetric(n=50, seed=1):
    a = np.random.RandomState(seed).rand(n, n)
    return a + a.T


def whole(m):
    return np.vstack([m.strip(s) for s in range(m.count)])


def many(spark, n=C.MOST_DENSE + 100):
    x = np.random.RandomState(3).rand(n, 2)
    points = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "x0": x[:, 0], "x1": x[:, 1], "z": np.sin(x[:, 0] * 3)}))
    return x, C.Covariance(points, sigma=1.0, sigma0=2.0, scale=0.05, kernel=K.Exponential(), kernel_threshold=0.1, options={"method": "cholesky", "solver": "dataframe-cg", "solver_tol": 1e-9})


def test_inverse_by_strips(spark):
    a = symmetric() + 3 * np.eye(50)
    m = T.Strips.built(spark, 50, 8, lambda at: a[at])
    negative, log = T.inverted(m)
    assert negative == (np.linalg.eigvalsh(a) < 0).sum() and log == pytest.approx(np.linalg.slogdet(a)[1])
    assert np.allclose(whole(m), np.linalg.inv(a))


def test_more_distinct_points_than_a_dense_task_holds(spark):
    x, c = many(spark)
    s = C.matrix(K.Exponential(), x, [0.05, 0.05], threshold=0.1) + 4.0 * np.eye(len(x))
    assert c.traceinv() == pytest.approx(np.trace(np.linalg.inv(s)))
    assert c.logdet() == pytest.approx(np.linalg.slogdet(s)[1])
    u = c.solve(c.points, ["z"]).toPandas().sort_values("i")["z"].to_numpy()
    assert np.allclose(s @ u, np.sin(x[:, 0] * 3), atol=1e-7)


def test_training_by_band(spark, monkeypatch):
    from gaussmill.plans import gaussian_process as G

    x = np.random.RandomState(5).rand(60, 2).round(2)
    x[40:50] = x[:10]
    z = np.sin(x[:, 0] * 3) + np.random.RandomState(6).rand(60) / 3
    points = spark.createDataFrame(pd.DataFrame({"i": np.arange(60), "x0": x[:, 0], "x1": x[:, 1], "z": z}))
    process = G.GaussianProcess(kernel=K.Exponential(), scale=0.3)
    for method in ("chandrupatla", "Newton-CG"):
        monkeypatch.setattr(G, "MOST_DENSE", 3000)
        dense = process.train(points, method=method).result
        monkeypatch.setattr(G, "MOST_DENSE", 20)
        monkeypatch.setattr(G.strips, "height_of", lambda n, most=0: 16)
        band = process.train(points, method=method).result
        assert band["n"] == 60 and band["success"] == dense["success"] and band["iterations"] == dense["iterations"]
        for name in ("posterior", "eta", "sigma", "sigma0", "beta"):
            assert band[name] == pytest.approx(dense[name], rel=1e-5)


def test_trace_with_matrices_by_strips(spark, monkeypatch):
    monkeypatch.setattr(C.strips, "height_of", lambda n, most=0: 16)
    x, c = many(spark, 40)
    r = np.random.RandomState(2)
    b, d = r.rand(40, 40), r.rand(40, 40)
    rows = lambda m: spark.createDataFrame(pd.DataFrame({"i": np.repeat(np.arange(40), 40), "j": np.tile(np.arange(40), 40), "v": m.ravel()}))
    p = np.linalg.inv(C.matrix(K.Exponential(), x, [0.05, 0.05], threshold=0.1) + 4.0 * np.eye(40))
    assert c.traceinv(B=rows(b), C=rows(d)) == pytest.approx(np.trace(b @ p @ d @ p))


def test_strips_are_stored_in_small_pieces(spark, monkeypatch):
    """Whole strips as values of one row did not fit the heap of an executor of 3,000 MB."""
    m = T.Strips.built(spark, 600, 512, lambda at: np.ones((at.stop - at.start, 600)))
    assert m.rows.selectExpr("max(length(data))").first()[0] <= 8 * T.PIECE < 8 * 512 * 600
    monkeypatch.setattr(T, "PIECE", 150)
    a = symmetric() + 3 * np.eye(50)
    m = T.Strips.built(spark, 50, 8, lambda at: a[at])
    entries = spark.createDataFrame(pd.DataFrame({"i": np.repeat(np.arange(50), 50) * 2, "j": np.tile(np.arange(50), 50) * 2, "v": a.ravel()}))
    other = T.Strips.of_entries(entries, np.arange(50) * 2, 8)
    assert m.rows.count() == other.rows.count() == 19 and np.array_equal(whole(m), whole(other))
    T.inverted(m)
    p = np.linalg.inv(a)
    assert np.allclose(whole(m), p)
    assert T.inner(T.multiplied(m, other), m) == pytest.approx(np.trace(p @ a @ p))
    assert T.weighted(m, other, np.arange(50.0)) == pytest.approx(np.arange(50) @ np.diag(p @ a @ p))


def test_trace_with_a_diagonal_matrix_by_strips(spark, monkeypatch):
    monkeypatch.setattr(C.strips, "height_of", lambda n, most=0: 16)
    monkeypatch.setattr(C.strips, "PIECE", 200)
    x, c = many(spark, 40)
    b, d = np.random.RandomState(2).rand(40, 40), np.arange(40) % 7 / 2
    rows = lambda i, j, v: spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "v": v}))
    at = np.flatnonzero(d)
    p = np.linalg.inv(C.matrix(K.Exponential(), x, [0.05, 0.05], threshold=0.1) + 4.0 * np.eye(40))
    assert c.traceinv(B=rows(np.repeat(np.arange(40), 40), np.tile(np.arange(40), 40), b.ravel()), C=rows(at, at, d[at])) == pytest.approx(np.trace(b @ p @ np.diag(d) @ p))


def test_products_evaluate_a_pair_once(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counted:
        def reach(self, threshold):
            return K.Exponential().reach(threshold)

        def __call__(self, r):
            seen.add(r.size)
            return K.Exponential()(r)

    r = np.random.RandomState(7)
    x, w, v = r.rand(300, 2), 1.0 + np.arange(300) % 3, r.rand(300, 2)
    for threshold, most in ((None, 0.6), (0.2, 0.6)):
        before = seen.value
        got = matrix_free.products(spark, x, w, [0.3, 0.2], Counted(), threshold)(v)
        assert np.allclose(got, w[:, None] * (C.matrix(K.Exponential(), x, [0.3, 0.2], threshold=threshold) @ (w[:, None] * v)))
        assert 0 < seen.value - before <= most * 300**2
