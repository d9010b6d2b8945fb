import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaussmill.functions import kernels
from gaussmill.functions import kernels as K
from gaussmill.functions import priors as P
from gaussmill.functions.basis import Basis
from gaussmill.operators import covariance as C
from gaussmill.operators import solvers
from gaussmill.operators.pairs import correlation, mirrored, taper_threshold
from gaussmill.plans import gaussian_process as G
from gaussmill.plans import tapered
from gaussmill.plans.likelihood import Evaluator
from gaussmill.plans.optimize import METHODS, bracket, find_root
from gaussmill.sources import points as S

SCALE = [0.3, 0.5]


def dense(upper, n):
    m = np.zeros((n, n))
    for r in mirrored(upper.select("i", "j", "v")).collect():
        m[r.i, r.j] = r.v
    return m


@pytest.fixture(scope="module")
def grid(spark):
    return S.lattice(spark, 6, 2).withColumn("z", F.sin(F.col("x0") * 3) + F.col("x1")).cache()


def array(points):
    return np.array([[r.x0, r.x1] for r in points.orderBy("i").collect()])


def test_points(spark):
    assert S.generate_points(spark, 10, 2, grid=True).count() == 100
    inside = S.generate_points(spark, 100, 2, a=(0.2, 0.3), b=(0.4, 0.5), contrast=0.7).where("x0 between 0.2 and 0.4 and x1 between 0.3 and 0.5").count()
    assert inside >= 70
    same = [S.generate_points(spark, 20, seed=3).orderBy("i").collect() for _ in range(2)]
    assert same[0] == same[1]
    with pytest.raises(ValueError):
        S.generate_points(spark, 10, contrast=2.0)
    bad = spark.createDataFrame([(1, None)], "i long, x0 double")
    with pytest.raises(Exception, match="null"):
        S.checked(bad).collect()


@pytest.mark.parametrize("kernel", [K.Matern(1.5), K.SquareExponential()], ids=str)
def test_pairs_equal_numpy(grid, kernel):
    x = array(grid)
    got = correlation(grid, SCALE, kernel, order=2)
    want = C.matrix_derivatives(kernel, x, SCALE, 2)
    for name, key in (("v", ()), ("d0", (0,)), ("d1", (1,)), ("h00", (0, 0)), ("h01", (0, 1)), ("h11", (1, 1))):
        assert np.allclose(dense(got.select("i", "j", F.col(name).alias("v")), 36), want[key], atol=1e-12)
    h = 1e-5
    up, down = C.matrix(kernel, x, [0.3 + h, 0.5]), C.matrix(kernel, x, [0.3 - h, 0.5])
    assert np.allclose(want[(0,)], (up - down) / (2 * h), atol=1e-6)


def test_tapered_pairs_equal_brute_force(grid):
    for kernel in (K.Exponential(), K.Linear()):
        near = correlation(grid, 0.4, kernel, threshold=0.2)
        brute = correlation(grid, 0.4, kernel).where("v >= 0.2")
        assert sorted(near.collect()) == sorted(brute.collect())
    with pytest.raises(ValueError):
        taper_threshold(1e-9, 36, 2, SCALE, K.Exponential())


@pytest.mark.parametrize("sigma", [0.0, 2.3])
@pytest.mark.parametrize("derivative", [(), (0,), (0, 1)])
def test_covariance_functions(grid, sigma, derivative):
    c = C.Covariance(grid, sigma=sigma, sigma0=3.2, scale=SCALE, kernel=K.Matern(0.5), options={"method": "eigenvalue"})
    s = sigma**2 * C.matrix_derivatives(c.kernel, array(grid), SCALE, 2)[derivative] + (0 if derivative else 3.2**2 * np.eye(36))
    assert np.allclose(dense(c.get_matrix(derivative=derivative), 36), s)
    z = np.array([r.z for r in grid.orderBy("i").collect()])
    column = lambda df: np.array([r.z for r in df.orderBy("i").collect()])
    for p in (0, 1) if derivative else (0, 1, 2, 3):
        power = np.linalg.matrix_power(s, p) if p or not derivative else np.zeros((36, 36))
        assert c.trace(derivative=derivative, p=p) == pytest.approx(np.trace(power), abs=1e-8)
        assert np.allclose(column(c.dot(grid, ["z"], derivative=derivative, p=p)), power @ z)
        if not derivative:
            assert c.logdet(p=p) == pytest.approx(np.linalg.slogdet(power)[1], abs=1e-8)
            assert c.traceinv(p=p) == pytest.approx(np.trace(np.linalg.inv(power)))
            assert np.allclose(column(c.solve(grid, ["z"], p=p)), np.linalg.solve(power, z))
    if derivative and sigma == 0:
        assert c.logdet(derivative=derivative) == -math.inf and math.isnan(c.traceinv(derivative=derivative))
    if derivative:
        with pytest.raises(NotImplementedError):
            c.trace(derivative=derivative, p=2)
        with pytest.raises(ValueError):
            c.with_options(method="cholesky").traceinv(2.0, 1.0, derivative=derivative)


def test_sparse_and_stochastic(grid):
    c = C.Covariance(grid, sigma=1.0, sigma0=1.0, scale=0.3, kernel=K.Exponential(), kernel_threshold=0.1, options={"solver_tol": 1e-10})
    k = C.matrix(c.kernel, array(grid), [0.3, 0.3], threshold=0.1) + np.eye(36)
    z = np.array([r.z for r in grid.orderBy("i").collect()])
    got = np.array([r.z for r in c.solve(grid, ["z"]).orderBy("i").collect()])
    assert np.allclose(got, np.linalg.solve(k, z), atol=1e-7)
    value, error = C.slq_logdet(c.correlation(), grid, 1.0, 8, 10)
    assert abs(value - np.linalg.slogdet(k)[1]) < 5 * error + 0.5


def test_stochastic_traces_of_powers_and_products(grid, spark):
    """Both estimators against numpy: powers, and products with matrices whose rows need not all hold entries."""
    c = C.Covariance(grid, sigma=2.0, sigma0=2.0, scale=0.3, kernel=K.Exponential(), kernel_threshold=0.1, options={"method": "slq", "max_num_samples": 8})
    m = np.linalg.inv(C.matrix(c.kernel, array(grid), [0.3, 0.3], threshold=0.1) + np.eye(36))
    ids = [r.i for r in grid.orderBy("i").collect()]
    b, d = np.diag(np.r_[np.arange(1.0, 36.0), 0.0]), np.eye(36)
    d[0, 1], d[35, 35] = 0.5, 0.0
    frame = lambda a: spark.createDataFrame([(ids[i], ids[j], float(a[i, j])) for i, j in zip(*a.nonzero(), strict=True)], "i long, j long, v double")
    value, error = C.slq_logdet(c.correlation(), grid, 1.0, 8, 10, function=lambda x: x**-2.0)
    assert abs(value - np.trace(m @ m)) < 5 * error + 0.05 and c.traceinv(p=2) == pytest.approx(value / 16)
    signs = np.array([tuple(r)[1:] for r in C.probes(grid, 8).orderBy("i").collect()])
    estimate = lambda a: float(np.einsum("ik,ij,jk->k", signs, a, signs).mean())
    value, error = C.hutchinson_traceinv(c.correlation(), grid, 1.0, 8, p=2, B=frame(b))
    assert value == pytest.approx(estimate(b @ m @ m), rel=1e-4) and abs(value - np.trace(b @ m @ m)) < 5 * error
    assert c.traceinv(B=frame(b), C=frame(d)) == pytest.approx(estimate(b @ m @ d @ m) / 16, rel=1e-4)


def test_tapered_weights_of_pure_noise(grid):
    """Where training ends at an infinite noise ratio, the weights are the residuals over the noise's variance."""
    process = G.GaussianProcess(kernel=K.Exponential(), scale=0.3)
    held = {"sigma": 0.0, "sigma0": 0.5, "eta": math.inf, "scale": [0.3, 0.3], "beta": [1.0], "c": [1.0], "threshold": 0.1, "options": {}, "n": 36}
    found = {r.i: r.w for r in G.GPModel(process, grid, held).weights().collect()}
    assert found == pytest.approx({r.i: (r.z - 1.0) / 0.25 for r in grid.collect()})


def evaluator(grid, proper=False):
    x = array(grid) + np.random.RandomState(0).rand(36, 2) / 50
    z = np.sin(3 * x[:, 0]) + x[:, 1] + np.random.RandomState(1).randn(36) / 10
    X = np.c_[np.ones(36), x]
    return Evaluator(x, z, X, K.Matern(1.5), *((np.ones(3), np.diag([1.0, 2.0, 3.0])) if proper else ()))


@pytest.mark.parametrize("proper", [False, True])
def test_likelihood_derivatives(grid, proper):
    e, h = evaluator(grid, proper), 1e-5
    g, hh = e.profile_derivatives(0.2, SCALE)
    f = lambda v: e.profile(v[0], list(v[1:]))
    d = lambda v: e.profile_derivatives(v[0], list(v[1:]))[0]
    v = np.r_[0.2, SCALE]
    for k in range(3):
        step = h * np.eye(3)[k]
        assert g[k] == pytest.approx((f(v + step) - f(v - step)) / (2 * h), rel=1e-4, abs=1e-5)
        assert np.allclose(hh[k], (d(v + step) - d(v - step)) / (2 * h), rtol=1e-4, atol=1e-4)
    g, hh = e.full_derivatives(0.9, 0.4, SCALE)
    f = lambda v: e.full(math.sqrt(v[0]), math.sqrt(v[1]), list(v[2:]))
    d = lambda v: e.full_derivatives(math.sqrt(v[0]), math.sqrt(v[1]), list(v[2:]))[0]
    v = np.r_[0.81, 0.16, SCALE]
    for k in range(4):
        step = h * np.eye(4)[k]
        assert g[k] == pytest.approx((f(v + step) - f(v - step)) / (2 * h), rel=1e-4, abs=1e-4)
        assert np.allclose(hh[k], (d(v + step) - d(v - step)) / (2 * h), rtol=1e-3, atol=1e-3)


def test_profile_is_the_maximum_over_sigma(grid):
    e = evaluator(grid)
    sigma, sigma0 = e.sigmas(0.2, SCALE)
    assert e.full(sigma, sigma0, SCALE) == pytest.approx(e.profile(0.2, SCALE))
    assert e.full(sigma * 1.01, sigma0 * 1.01, SCALE) < e.profile(0.2, SCALE)


def test_asymptotic_slope_and_value(grid):
    e = evaluator(grid)
    a = e.asymptotic(SCALE)
    for eta in (1e3, 1e4):
        assert a["slope"](eta) == pytest.approx(e.profile_derivatives(eta, SCALE)[0][0], rel=1e-3)
        assert a["value"](eta) == pytest.approx(e.profile(eta, SCALE), abs=1e-2)


def test_roots():
    f = lambda x: math.exp(x) - 2
    for method in ("chandrupatla", "brentq"):
        assert find_root(f, -1.0, 3.0, method, 1e-10) == pytest.approx(math.log(2), abs=1e-8)
    a, b = bracket(f, -3.0, -1.0)
    assert f(a) * f(b) <= 0
    assert bracket(lambda x: 1.0 + x * x, -1, 1) is None


@pytest.fixture(scope="module")
def noisy(spark):
    points = S.generate_data(S.generate_points(spark, 50, 1, a=0.4, b=0.6, contrast=0.8))
    return points.withColumn("z", F.col("z") + F.sin(F.col("i") * 12.9) * 0.05).cache()


def test_every_method_finds_the_same_optimum(noisy):
    process = G.GaussianProcess(G.LinearModel(Basis(1)), K.Exponential(), 0.2)
    found = {m: process.train(noisy, method=m) for m in (*METHODS, "chandrupatla", "brentq")}
    best = max(m.result["posterior"] for m in found.values())
    for name, model in found.items():
        assert model.result["posterior"] == pytest.approx(best, abs=1e-4), name
    full = process.train(noisy, profile="none", method="Nelder-Mead")
    assert full.result["posterior"] == pytest.approx(best, abs=1e-3)
    assert found["Newton-CG"].summary().first().optimization.success
    assert found["BFGS"].convergence().count() > 0


def test_scale_is_searched_with_a_prior(noisy):
    process = G.GaussianProcess(kernel=K.Matern(1.5), prior=P.InverseGamma(4.0, 2.0))
    a, b = (process.train(noisy, method=m) for m in ("Newton-CG", "Nelder-Mead"))
    assert a.result["posterior"] == pytest.approx(b.result["posterior"], abs=1e-3)
    both = G.GaussianProcess(kernel=K.Matern(1.5), scale=0.5).train(noisy, profile="var_noise", method="Nelder-Mead")
    assert both.result["posterior"] >= G.GaussianProcess(kernel=K.Matern(1.5), scale=0.5).train(noisy).result["posterior"] - 1e-6


def test_prediction(spark, noisy):
    for mean in (G.LinearModel(Basis(1)), G.LinearModel(Basis(1), orthonormalize=True), G.LinearModel(Basis(1), np.zeros(2), np.eye(2))):
        model = G.GaussianProcess(mean, K.Exponential(), 0.2).train(noisy)
        tests = S.lattice(spark, 20)
        plain = {r.t: r.mean for r in model.predict(tests).collect()}
        band = {r.t: r for r in model.predict_band(tests).collect()}
        cov = {(r.t, r.u): r.cov for r in model.predict_covariance(tests).collect()}
        assert len(plain) == len(band) == 20
        for t, r in band.items():
            assert plain[t] == pytest.approx(r.mean, abs=1e-8)
            assert cov[t, t] == pytest.approx(r.sd**2, abs=1e-8)
            assert r.lo < r.mean < r.hi
        assert max(abs(plain[t] - math.sin(math.pi * t / 19)) for t in range(8, 19)) < 0.3  # where there are points


def test_stream_scoring(spark, noisy, tmp_path):
    from gaussmill.streaming.scoring import score_stream

    model = G.GaussianProcess(kernel=K.Exponential(), scale=0.2).train(noisy)
    S.lattice(spark, 10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, x0 double").parquet(str(tmp_path / "in"))
    got = []
    query = score_stream(model, stream, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"), availableNow=True)
    query.awaitTermination(120)
    want = {r.t: r.mean for r in model.predict(S.lattice(spark, 10)).collect()}
    assert {r.t: pytest.approx(r.mean) for r in got} == want


def test_checks(spark, grid):
    with pytest.raises(ValueError):
        C.Covariance(grid, sigma=-1.0)
    with pytest.raises(ValueError):
        C.Covariance(grid, scale=[1.0, 2.0, 3.0]).get_scale()
    with pytest.raises(ValueError):
        G.LinearModel(B=-np.eye(2))
    with pytest.raises(Exception, match="too many"):
        C.local(spark.range(20).withColumnRenamed("id", "i"), lambda rows: rows, "i long", most=10).collect()


def test_runtime(spark):
    from gaussmill.runtime import Memory, Timer, get_config, human_readable, info

    t = Timer()
    for _ in range(2):
        t.tic()
        t.toc()
    assert t.count == 2 and t.wall_time >= 0
    with pytest.raises(RuntimeError):
        t.toc()
    m = Memory()
    m.start()
    m.stop()
    assert m.get_mem() >= 0 and human_readable(2048) == (2, "Kb")
    assert info(spark).count() == 1 and get_config(spark, "shuffle_partitions") == 4


def packed(K, spread=7):
    i, j = np.nonzero(np.triu(K))
    return solvers.Packed(spread * np.arange(len(K)), spread * i, spread * j, K[i, j])


@pytest.mark.parametrize("name", solvers.SOLVERS)
def test_solvers(name):
    rng = np.random.RandomState(3)
    K = rng.randn(80, 80) * (rng.rand(80, 80) < 0.1)
    K = K + K.T + np.diag(np.full(80, 12.0) if name == "cg" else np.where(np.arange(80) % 3, 9.0, -9.0))
    y = np.c_[rng.randn(80, 2), np.zeros(80)]
    m = packed(K)
    assert np.allclose(m.dot(y), K @ y)
    got = solvers.solve(m, 0.3, y, name, 1e-12)
    assert np.allclose(got, np.linalg.solve(K + 0.3 * np.eye(80), y), atol=1e-8)
    if name == "cg":
        with pytest.raises(ArithmeticError):
            solvers.solve(m, -20.0, y, name)


def test_tapered_profile_equals_dense():
    rng = np.random.RandomState(1)
    x, X = rng.rand(120, 2), None
    X = np.c_[np.ones(120), x]
    z = np.sin(3 * x[:, 0]) + rng.randn(120) / 5
    e = Evaluator(x, z, X, kernels.Exponential(), threshold=0.1)
    K = e.k([0.1, 0.1])[()]
    exact = e.at_scale([0.1, 0.1])
    own = tapered.TaperedProfile(packed(K, 1), z, X, {"max_num_samples": 400, "lanczos_degree": 120})
    for eta in (0.5, 3.0):
        assert own.variance(eta) == pytest.approx(exact.variance(eta), rel=1e-6)
        assert own.profile(eta) == pytest.approx(exact.profile(eta), abs=1.5)
        assert own.derivatives(eta) == pytest.approx(exact.derivatives(eta), rel=0.1)
    assert own.profile(own.least / 2) == -np.inf if own.least else own.profile(1e-3) < np.inf


def test_spectral_profile_equals_the_evaluator(noisy):
    rng = np.random.RandomState(2)
    x, z = rng.rand(40, 2), rng.randn(40)
    for B in (None, np.array([[2.0, 0.1], [0.1, 1.0]])):
        e = Evaluator(x, z, np.c_[np.ones(40), x[:, 0]], kernels.Matern(1.5), None if B is None else np.zeros(2), B)
        own = e.at_scale([0.3, 0.5])
        for eta in (0.01, 1.0, 50.0):
            g, h = e.profile_derivatives(eta, [0.3, 0.5])
            assert own.profile(eta) == pytest.approx(e.profile(eta, [0.3, 0.5])) and own.derivatives(eta) == pytest.approx((g[0], h[0, 0]))
            assert own.full(1.3, 0.4) == pytest.approx(e.full(1.3, 0.4, [0.3, 0.5]))


def test_guesses_and_tapered_training(spark):
    data = S.generate_data(S.lattice(spark, 12, 2), 0.2, 1)
    process = G.GaussianProcess(kernel=kernels.Exponential(), scale=0.05)
    for guess in ([-1.0], [1.0, 2.0], [float("nan")]):
        with pytest.raises(ValueError):
            process.train(data, guess=guess)
    with pytest.raises(ValueError):
        process.train(data, threshold=0.1, profile="none")
    model = process.train(data, threshold=0.05, method="chandrupatla")
    mean = {r.t: r.mean for r in model.predict(data.drop("z")).collect()}
    rows = data.orderBy("i").toPandas()
    r = model.result
    x, z = rows[["x0", "x1"]].to_numpy(), rows["z"].to_numpy()
    K = C.matrix(kernels.Exponential(), x, r["scale"], threshold=0.05)
    w = np.linalg.solve(K + r["eta"] * np.eye(len(z)), z - r["beta"][0])
    assert np.allclose([mean[i] for i in rows["i"]], r["beta"][0] + K @ w, atol=1e-5)
    assert model.prediction_summary(data.drop("z")).first()["tests"] == 144
    far = spark.createDataFrame([(1, 50.0, 50.0)], "i long, x0 double, x1 double")
    assert model.predict(far).first()["mean"] == pytest.approx(r["beta"][0])
