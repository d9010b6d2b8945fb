"""Points of equal coordinates: covariances and training work on distinct locations and equal what numpy makes of all points."""

import numpy as np
import pandas as pd
import pytest

from gaussmill.functions import kernels as K
from gaussmill.operators import covariance as C
from gaussmill.plans import gaussian_process as G
from gaussmill.plans.likelihood import Evaluator


def cloud(n=12, copies=3):
    """Points in mixed order, with z that differs between copies; the first place has no copies."""
    r = np.random.RandomState(1)
    x = np.vstack([np.repeat(r.rand(n, 2).round(2), copies, axis=0)[copies - 1 :]])[r.permutation(n * copies - copies + 1)]
    return x, np.sin(x[:, 0] * 3) + x[:, 1] + r.rand(len(x)) / 5


def frame(spark, x, z):
    return spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x0": x[:, 0], "x1": x[:, 1], "z": z}))


@pytest.mark.parametrize("cut", [None, 0.1])
def test_covariance_of_copies(spark, cut):
    x, z = cloud()
    points = frame(spark, x, z)
    s = 4.0 * C.matrix(K.Exponential(), x, [0.3, 0.3], threshold=cut) + 2.25 * np.eye(len(x))
    for options in ({}, {"solver": "minres"}, {"solver": "dataframe-cg"}) if cut else ({},):
        c = C.Covariance(points, sigma=2.0, sigma0=1.5, scale=0.3, kernel=K.Exponential(), kernel_threshold=cut, options={"method": "cholesky", "solver_tol": 1e-11} | options)
        for p in (1, 2) if not options else (1,):
            u = np.array([r.z for r in c.solve(points, ["z"], p=p).orderBy("i").collect()])
            assert np.allclose(u, np.linalg.solve(np.linalg.matrix_power(s, p), z), atol=1e-8)
    for p in (1, 2):
        assert c.logdet(p=p) == pytest.approx(p * np.linalg.slogdet(s)[1])
        assert c.traceinv(p=p) == pytest.approx(np.trace(np.linalg.inv(np.linalg.matrix_power(s, p))))
    slq = c.with_options(method="slq", max_num_samples=4, lanczos_degree=12)
    assert slq.logdet() == pytest.approx(np.linalg.slogdet(s)[1], rel=0.1)


def test_more_copies_than_a_dense_task_holds(spark):
    """6,000 points at 12 places, refused before for their number."""
    points = spark.range(6000).selectExpr("id as i", "(id % 4) / 5.0D as x0", "floor(id / 4) % 3 / 4.0D as x1").selectExpr("*", "sin(x0 * 3) + x1 + (i % 7) / 50.0D as z")
    c = C.Covariance(points, sigma=1.0, sigma0=1.0, scale=0.3, kernel=K.Exponential(), kernel_threshold=0.1)
    own = np.array([(a / 5, b / 4) for a in range(4) for b in range(3)])
    lam = np.linalg.eigvalsh(C.matrix(K.Exponential(), own, [0.3, 0.3], threshold=0.1)) * 500
    assert c.logdet() == pytest.approx(np.log(lam + 1).sum()) and c.traceinv() == pytest.approx((1 / (lam + 1)).sum() + 6000 - 12)
    model = G.GaussianProcess(kernel=K.Exponential(), scale=0.3).train(points)
    assert model.result["n"] == 6000 and model.result["success"]


@pytest.mark.parametrize("prior", [None, [[0.5]]])
def test_likelihood_of_copies(prior):
    x, z = cloud()
    X = np.ones((len(x), 1))
    b = None if prior is None else np.array([0.3])
    whole = Evaluator(x, z, X, K.Matern(1.5), b, None if prior is None else np.array(prior))
    table = pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "z": z}).groupby(["x0", "x1"])["z"].agg(["mean", "size", lambda v: ((v - v.mean()) ** 2).sum()])
    own = np.array([list(k) for k in table.index])
    held = Evaluator(own, table["mean"].to_numpy(), np.ones((len(own), 1)), K.Matern(1.5), b, whole.B, None, table["size"].to_numpy(float), float(table.iloc[:, 2].sum()))
    assert held.n == len(x) and held.size < len(x)
    scale = [0.3, 0.5]
    for a, c in (
        (whole.profile(0.2, scale), held.profile(0.2, scale)), (whole.sigmas(0.2, scale), held.sigmas(0.2, scale)), (whole.full(1.1, 0.4, scale), held.full(1.1, 0.4, scale)), (whole.ols_sigma0(), held.ols_sigma0()),
        *zip(whole.full_derivatives(1.1, 0.4, scale), held.full_derivatives(1.1, 0.4, scale), strict=True), *zip(whole.profile_derivatives(0.2, scale), held.profile_derivatives(0.2, scale), strict=True),
        *zip(whole.coefficients(1.1, 0.4, scale), held.coefficients(1.1, 0.4, scale), strict=True), (whole.at_scale(scale).profile(0.2), held.at_scale(scale).profile(0.2)),
        (whole.at_scale(scale).derivatives(0.2), held.at_scale(scale).derivatives(0.2)), (whole.asymptotic(scale)["coefficients"], held.asymptotic(scale)["coefficients"]),
    ):
        assert np.allclose(a, c, rtol=1e-7, atol=1e-9)


def test_indefinite_tapered_systems(spark):
    """Copies multiply the negative eigenvalues that cutting leaves: conjugate gradients alone can't serve them."""
    x = np.repeat(np.random.RandomState(4).rand(150, 2), 2, axis=0)
    k = C.matrix(K.Exponential(), x, [0.2, 0.2], threshold=0.3) + 0.04 * np.eye(300)
    assert np.linalg.eigvalsh(k)[0] < -0.1
    z = np.sin(x[:, 0] * 3) + np.arange(300) % 2
    for solver in ("cg", "minres", "gmres", "dataframe-cg"):
        c = C.Covariance(frame(spark, x, z), sigma=1.0, sigma0=0.2, scale=0.2, kernel=K.Exponential(), kernel_threshold=0.3, options={"solver": solver, "solver_tol": 1e-11})
        assert np.allclose([r.z for r in c.solve(c.points, ["z"]).orderBy("i").collect()], np.linalg.solve(k, z), atol=1e-6)


def test_conjugate_gradients_as_rows(spark):
    x, z = cloud(20, 1)
    points = frame(spark, x, z)
    c = C.Covariance(points, sigma=1.0, sigma0=1.0, scale=0.3, kernel=K.Exponential(), kernel_threshold=0.1)
    u = C.conjugate_gradient(c.correlation(), points, ["z"], 1.0, 1e-9, packed=0)
    assert np.allclose([r.z for r in u.orderBy("i").collect()], np.linalg.solve(C.matrix(K.Exponential(), x, [0.3, 0.3], threshold=0.1) + np.eye(20), z), atol=1e-7)
    with pytest.raises(ArithmeticError):
        C.conjugate_gradient(c.correlation(), points, ["z"], -3.0, 1e-9, packed=0)
