"""Elimination of cut kernels in tasks that send each other block columns equals numpy."""

import numpy as np
import pandas as pd
import pytest

from gaussmill.functions import kernels as K
from gaussmill.operators import covariance as C
from gaussmill.operators import envelope as V


def system(n=203, eta=1.0, seed=1):
    r = np.random.RandomState(seed)
    x, w = r.rand(n, 2), 1.0 + r.randint(0, 3, n)
    return x, w, C.matrix(K.Exponential(), x, [0.1, 0.1], threshold=0.05) * w[:, None] * w + eta * np.eye(n), r.rand(n, 3)


@pytest.mark.parametrize("kept", [60_000_000, 300])
def test_solves_by_elimination(spark, monkeypatch, kept):
    """Definite and indefinite, and with room for the last rows only; generalised minimal residuals did not end on crowded points."""
    monkeypatch.setattr(V, "HEIGHT", 16)
    monkeypatch.setattr(V, "KEPT", kept)
    for eta in (1.0, -0.15):
        x, w, a, y = system(eta=eta)
        m = V.Envelope.of(x, w, [0.1, 0.1], K.Exponential(), 0.05, eta)
        assert (m.kept_from(V.tasks_of(spark)) > 0) == (kept == 300) and m.low[-1] > 0
        assert np.allclose(V.solve(spark, m, y, lambda v, a=a: a @ v, 1e-10), np.linalg.solve(a, y))
    assert np.linalg.eigvalsh(a)[0] < -0.01


def test_many_points_are_solved_by_elimination(spark, monkeypatch):
    monkeypatch.setattr(C.matrix_free, "solve", None)
    x = np.random.RandomState(3).rand(C.MOST_DENSE + 100, 2)
    points = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x0": x[:, 0], "x1": x[:, 1], "z": np.sin(x[:, 0] * 3)}))
    c = C.Covariance(points, sigma=1.0, sigma0=0.3, scale=0.1, kernel=K.Exponential(), kernel_threshold=0.1, options={"solver": "dataframe-cg", "solver_tol": 1e-9})
    s = C.matrix(K.Exponential(), x, [0.1, 0.1], threshold=0.1) + 0.09 * np.eye(len(x))
    assert np.linalg.eigvalsh(s)[0] < -0.1
    u = c.solve(points, ["z"]).toPandas().sort_values("i")["z"].to_numpy()
    assert np.allclose(s @ u, np.sin(x[:, 0] * 3), atol=1e-7)


def test_more_entries_than_a_task_packs(spark, monkeypatch):
    """They were refused."""
    monkeypatch.setattr(C.solvers, "MOST_ENTRIES", 1000)
    x = np.random.RandomState(4).rand(120, 2)
    points = spark.createDataFrame(pd.DataFrame({"i": np.arange(120), "x0": x[:, 0], "x1": x[:, 1], "z": np.sin(x[:, 0] * 3)}))
    c = C.Covariance(points, sigma=1.0, sigma0=1.0, scale=0.1, kernel=K.Exponential(), kernel_threshold=0.05, options={"solver": "minres", "solver_tol": 1e-10})
    assert not c.packs()
    a = C.matrix(K.Exponential(), x, [0.1, 0.1], threshold=0.05) + np.eye(120)
    assert np.allclose([r.z for r in c.solve(points, ["z"]).orderBy("i").collect()], np.linalg.solve(a, np.sin(x[:, 0] * 3)))


def test_traces_and_estimates_by_elimination(spark, monkeypatch):
    """Of an indefinite matrix too, where strips of n^2 numbers filled the disk at size."""
    monkeypatch.setattr(V, "HEIGHT", 64)
    x = np.random.RandomState(4).rand(120, 2)
    points = spark.createDataFrame(pd.DataFrame({"i": np.arange(120), "x0": x[:, 0], "x1": x[:, 1]}))
    c = C.Covariance(points, sigma=1.0, sigma0=1.0, scale=0.1, kernel=K.Exponential(), kernel_threshold=0.05)
    k, d = C.matrix(K.Exponential(), x, [0.1, 0.1], threshold=0.05), 1 + x[:, 0] ** 2
    for eta in (-0.25,):
        p = np.linalg.inv(k + eta * np.eye(120))
        exact, value, error = c.inverse_traces(eta)
        assert exact == pytest.approx(np.trace(p)) and abs(value - exact) <= 5 * error
        exact, value, error = c.inverse_traces(eta, diagonal=points.selectExpr("i", "i as j", "1 + x0 * x0 as v"))
        assert exact == pytest.approx(np.trace(k @ p @ np.diag(d) @ p)) and abs(value - exact) <= 5 * error
    monkeypatch.setattr(C, "MOST_DENSE", 20)
    exact, (value, error) = c.logdet(), c.slq_unstored(1.0, 10, 12)
    assert exact == pytest.approx(np.linalg.slogdet(k + np.eye(120))[1]) and abs(value - exact) <= 5 * error
