"""Registered queries of likelihoods, posteriors and matrix functions whose SQL works on explicit inverses.

The SQL inverts by Gauss-Jordan elimination on lists, for any number of keyed
matrices at once, and forms every trace and product by joins on entries.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaussmill.functions import basis as B
from gaussmill.functions import kernels as K
from gaussmill.functions import priors as P
from gaussmill.operators import covariance as C
from gaussmill.operators import pairs as R
from gaussmill.operators import sums as Z
from gaussmill.plans import gaussian_process as G
from gaussmill.plans import likelihood as H
from gaussmill.queries import DIST, ETA, GRID, KERNELS, M15, NAT, SCALE, SUP, A0, A1, _r, one, rounded
from gaussmill.sources import points as S

SIGMA, SIGMA0 = 2.0, 0.7
SCALES, SIGMAS, SIGMA0S = (0.1, 0.3, 1.0), (0.5, 2.0), (0.7, 1.5)
PRIOR = P.InverseGamma(4.0, 2.0)
LARGE = (50.0, 200.0)
TAPER = 0.3


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nation_points(spark, sf_dir)


def profile_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile likelihood, slope and curvature over scales and noise ratios."""
    t = H.profile_surface(_nation(spark, sf_dir), K.Exponential(), list(SCALES), B.Basis(0), list(GRID))
    return rounded(t.withColumn("scale", F.col("scale")[0]), ("eta", "scale"))


def full_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full likelihood over scales and both deviations."""
    t = H.full_surface(_nation(spark, sf_dir), K.Exponential(), list(SCALES), B.Basis(0), list(SIGMAS), list(SIGMA0S))
    return rounded(t.withColumn("scale", F.col("scale")[0]), ("scale", "sigma", "sigma0"))


def double_profile_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(e,) for e in GRID], "eta double")
    t = H.double_profile(_nation(spark, sf_dir), K.Exponential(), list(SCALES), B.Basis(0), grid)
    return rounded(t.select("eta", "ell", F.col("scale")[0].alias("scale"), "sigma", "sigma0"), ("eta", "scale"))


def full_loglik_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full likelihood with gradient and Hessian by sigma^2, sigma0^2 and both scales."""
    return rounded(H.full_derivatives_table(_nation(spark, sf_dir), K.Exponential(), B.Basis(0), SIGMA, SIGMA0, SCALE))


def profile_loglik_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile likelihood with gradient and Hessian by eta and both scales."""
    return rounded(H.profile_derivatives_table(_nation(spark, sf_dir), K.Exponential(), B.Basis(0), ETA, SCALE))


def log_posterior_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log posterior with an inverse-gamma prior of the scales, gradient and Hessian by log10 of all parameters."""
    return rounded(H.full_derivatives_table(_nation(spark, sf_dir), K.Exponential(), B.Basis(0), SIGMA, SIGMA0, SCALE, PRIOR, log=True))


def asymptotic_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion of the slope for large eta: coefficients, slope, its derivative, and the value at two noise ratios."""
    t = H.asymptotic_table(_nation(spark, sf_dir), K.Exponential(), B.Basis(0), SCALE, list(LARGE))
    return rounded(t.where("what <> 'maximum'"))


def beta_gls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of a constant by generalised least squares, with a flat prior (kind 0) and a normal one (kind 1)."""
    args = _nation(spark, sf_dir), K.Exponential(), B.Basis(0), SIGMA, SIGMA0, SCALE
    flat, normal = H.beta_table(*args), H.beta_table(*args, b=[3.0], B=[[0.5]])
    return rounded(flat.withColumn("kind", F.lit(0)).unionByName(normal.withColumn("kind", F.lit(1))))


def _cov(spark: SparkSession, sf_dir: str, **more) -> C.Covariance:
    return C.Covariance(_nation(spark, sf_dir), sigma=SIGMA, sigma0=SIGMA0, scale=SCALE, kernel=K.Exponential(), **more)


def cov_trace_bc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tr B S^-1 and tr B S^-1 C S^-1 with B the correlation and C a lower triangle of ones; and tr B C."""
    c = _cov(spark, sf_dir)
    b = R.mirrored(c.correlation())
    lower = c.points.select("i").join(c.points.select(F.col("i").alias("j")), F.col("j") <= F.col("i")).withColumn("v", F.lit(1.0))
    return one(spark, b1=c.traceinv(B=b), bc=c.traceinv(B=b, C=lower), p0=c.traceinv(p=0, B=b, C=lower))


def cov_trace_real_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of powers that come from the spectrum: -1, 4, and 1/2 bounded by tr S / sqrt(largest) and sqrt(n tr S)."""
    c = _cov(spark, sf_dir)
    half, whole, n = c.trace(p=0.5), c.trace(), c.get_size()
    top = float(c.extreme_eigenvalues().first()["high"]) * SIGMA**2 + SIGMA0**2
    t = one(spark, pm1=c.trace(p=-1.0), p4=c.trace(p=4))
    return t.withColumn("half_bounded", F.lit(whole / math.sqrt(top) <= half <= math.sqrt(n * whole)))


def extreme_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cov(spark, sf_dir).extreme_eigenvalues())


def der1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the slope by eta from the extreme eigenvalues."""
    spec = H.spectrum(_nation(spark, sf_dir), K.Exponential(), SCALE, B.Basis(0))
    return rounded(H.slope_bounds(spec, spark.createDataFrame([(e,) for e in GRID], "eta double"), 1), ("eta",))


def cov_derivative_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces and squares of the derivatives of S by the scales, and one product."""
    c = _cov(spark, sf_dir)
    square = lambda d: R.mirrored(c.get_matrix(derivative=d)).agg(F.sum(F.col("v") * F.col("v"))).first()[0]
    squares = {f"sq{a}{b}": square(d) for d, a, b in (((0,), 0, "x"), ((1,), 1, "x"), ((0, 0), 0, 0), ((0, 1), 0, 1), ((1, 1), 1, 1))}
    dot = c.dot(c.points, ["z"], derivative=(0,)).agg(F.sum("z")).first()[0]
    return one(spark, **squares, t0=c.trace(derivative=(0,)), dot=dot)


def corr_taper_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row sums of a tapered Matern 3/2 correlation and its derivatives on the kept entries."""
    return rounded(Z.row_sums(S.supplier_points(spark, sf_dir), SCALE, K.Matern(1.5), order=2, threshold=TAPER).drop("n"))


def _tapered(spark: SparkSession, sf_dir: str, **options) -> C.Covariance:
    return C.Covariance(S.supplier_points(spark, sf_dir), sigma=1.0, sigma0=1.0, scale=0.1, kernel=K.Exponential(), kernel_threshold=0.05, options={"method": "cholesky", "solver_tol": 1e-10} | options)


def cg_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One solve with the tapered matrix of the suppliers at any number of them: products without stored entries once there are many."""
    c = _tapered(spark, sf_dir, solver="dataframe-cg")
    return rounded(c.solve(c.points, ["z"]).withColumnRenamed("z", "u"))


def sparse_solvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tapered system by three methods on packed entries; of more entries than a task holds one elimination serves all three."""
    out, c = None, _tapered(spark, sf_dir)
    if not _locations(c)[0].packs():
        names = F.explode(F.array(*map(F.lit, ("cg", "minres", "gmres"))))
        return rounded(c.solve(c.points, ["z"]).select("i", names.alias("solver"), F.col("z").alias("u")))
    for name in ("cg", "minres", "gmres"):
        c = _tapered(spark, sf_dir, solver=name)
        part = c.solve(c.points, ["z"]).select("i", F.lit(name).alias("solver"), F.col("z").alias("u"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def _estimate(spark: SparkSession, exact: float, value: float, error: float) -> DataFrame:
    return one(spark, exact=exact).withColumn("within", F.lit(bool(abs(value - exact) <= 5 * error)))


def _locations(c: C.Covariance) -> tuple[C.Covariance, int]:
    """The covariance of the locations, and the number of surplus copies, each an eigenvalue of 1 of K + I."""
    own = c.located()
    own = C.replace(own, points=C.checkpointed(own.points))
    return own, c.get_size() - own.get_size()


def stochastic_traceinv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact trace of the inverse, and whether Hutchinson's estimate lies within five standard errors."""
    c = _tapered(spark, sf_dir)
    own, surplus = _locations(c)
    if own.get_size() > C.MOST_DENSE:
        exact, value, error = own.inverse_traces(1.0)
        return _estimate(spark, exact + surplus, value + surplus, error)
    value, error = C.hutchinson_traceinv(own.correlation(), own.points, 1.0, 10, solve=own.unstored_solve(1.0))
    return _estimate(spark, c.traceinv(), value + surplus, error)


def stochastic_traceinv_bc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact tr B M^-1 C M^-1 with B the tapered correlation and C the diagonal 1 + x0^2, and whether Hutchinson's estimate lies within five standard errors."""
    c, _ = _locations(_tapered(spark, sf_dir))  # B maps what surplus copies add to zero, and C, alike at all copies, keeps both parts apart
    b, diagonal = R.mirrored(c.correlation()), c.points.select("i", F.col("i").alias("j"), (1.0 + F.col("x0") * F.col("x0")).alias("v"))
    if c.get_size() > C.MOST_DENSE:
        return _estimate(spark, *c.inverse_traces(1.0, diagonal=diagonal))
    return _estimate(spark, c.traceinv(B=b, C=diagonal), *C.hutchinson_traceinv(c.correlation(), c.points, 1.0, 10, B=b, C=diagonal, solve=c.unstored_solve(1.0)))


def slq_logdet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact log determinant, and whether Lanczos quadrature lies within five standard errors."""
    c = _tapered(spark, sf_dir)
    own, _ = _locations(c)  # surplus copies add the logarithm of 1
    if own.get_size() > C.MOST_DENSE:
        return _estimate(spark, c.logdet(), *own.slq_unstored(1.0, 10, 12))
    return _estimate(spark, c.logdet(), *C.slq_logdet(own.correlation(), own.points, 1.0, 10, 12))


def gp_predict_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaussmill.queries import _fixed_model

    return rounded(_fixed_model(spark, sf_dir).predict_band(S.customer_points(spark, sf_dir)))


def gp_train_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training on the nations by Newton's method and by root finding: the best profile likelihood, and whether the slope vanishes there."""
    points = _nation(spark, sf_dir).withColumn("z", F.sin(F.col("x0") * 2 * math.pi) + (F.col("i") * F.col("i") * 7 % 11) / 5)
    process = G.GaussianProcess(kernel=K.Exponential(), scale=SCALE)
    out = []
    for method in ("Newton-CG", "chandrupatla"):
        r = process.train(points, method=method, guess=[1.0]).result
        slope = H.profile_derivatives_table(points, K.Exponential(), B.Basis(0), r["eta"], SCALE).where("p = 0 and q = -1").first()["v"]
        out.append((method, round(r["posterior"], 4), bool(abs(slope * r["eta"]) < 1e-3)))
    return spark.createDataFrame(out, "method string, posterior double, stationary boolean")


def gp_train_tapered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tapered training on a lattice of 400 noisy points by quadrature and conjugate gradients: is its optimum the dense one's, within 0.5 of the log-likelihood?"""
    data = S.generate_data(S.lattice(spark, 20, 2)).withColumn("z", F.col("z") + F.sin(F.col("x0") * 9) * F.cos(F.col("x1") * 7) + (F.pmod(F.xxhash64("i"), F.lit(1000)) / 1000.0 - 0.5))
    process = G.GaussianProcess(kernel=K.Exponential(), scale=0.1, mean=G.LinearModel(B.Basis(2)))
    model = process.train(data, threshold=0.05, method="chandrupatla", guess=[1.0])
    eta = model.result["eta"]
    found = H.point_tables(data, B.Basis(2), lambda x, z, X: _gap(x, z, X, eta), "gap double").first()["gap"]
    mean = model.predict(S.lattice(spark, 5, 2, 0.1, 0.9))
    return spark.createDataFrame([(int(model.result["n"]), bool(abs(found) < 0.5), mean.count())], "n long, close boolean, predicted long")


def _gap(x, z, X, eta: float) -> list[dict]:
    """How far the dense tapered profile at eta lies under its best on a grid."""
    own = H.Evaluator(x, z, X, K.Exponential(), threshold=0.05).at_scale([0.1, 0.1])
    return [{"gap": max(own.profile(e) for e in (10.0 ** (k / 10) for k in range(-30, 31)) if e > -own.value.min()) - own.profile(min(eta, 1e6))}]


def kernel_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot data of the kernels without Bessel functions: values, and central differences beside the derivatives."""
    out = None
    for name in ("k_exponential", "k_square_exponential", "k_linear", "k_rational_quadratic", "k_matern_15"):
        part = KERNELS[name][0].table(spark, 4.0, 101).withColumn("kernel", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, ("x",)).withColumn("x", F.round("x", 6))


def prior_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First guesses of the scale by each prior, one for each supplier nation's parameters."""
    rows = []
    for k in sorted(r[0] for r in S.read(spark, sf_dir, "nation").select("n_nationkey").collect()):
        a, b = 1.0 + k / 10, 2.0 + k / 5
        priors = {"uniform": P.Uniform(a, a + b), "half_bounded": P.Uniform(a, math.inf), "normal": P.Normal(a, b), "half_normal": P.Normal(0.0, b, half=True), "cauchy": P.Cauchy(a, b), "student_t": P.StudentT(a), "gamma": P.Gamma(a, b), "erlang": P.Erlang(k + 1, b), "inverse_gamma": P.InverseGamma(a, b), "beta_prime": P.BetaPrime(a, b)}
        rows += [(k, name, float(p.suggest_hyperparam(positive=True))) for name, p in priors.items()]
    return rounded(spark.createDataFrame(rows, "k long, prior string, guess double"))


def sample_points_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice points with raised contrast: 8 per axis in a box, 2 per axis in the cube."""
    return rounded(S.generate_data(S.generate_points(spark, 10, 2, grid=True, a=(0.2, 0.3), b=(0.4, 0.5), contrast=0.8)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        profile_surface, full_surface, double_profile_argmax, full_loglik_derivatives, profile_loglik_derivatives, log_posterior_derivatives, asymptotic_slope, beta_gls, cov_trace_bc, cov_trace_real_p,
        extreme_eigenvalues, der1_bounds, cov_derivative_functions, corr_taper_derivatives, cg_solve, sparse_solvers, stochastic_traceinv, stochastic_traceinv_bc, slq_logdet, gp_predict_band, gp_train_nation, gp_train_tapered, kernel_tables,
        prior_suggestions, sample_points_grid,
    )
}


# SQL


def _inverses(source: str, x: str = "") -> str:
    """CTEs o (places), c, rows_, g and inv(key, logdet, i, j, v): the inverse of each matrix of source(key, i, j, v).  x ends their names."""
    return f"""o{x} AS (SELECT i, CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS r FROM n), c{x} AS (SELECT CAST(count(*) AS INTEGER) AS n FROM n),
        rows_{x} AS (SELECT key, i, list_concat(list(v ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END ORDER BY j)) AS r FROM {source} GROUP BY key, i),
        g{x}(key, step, m, logdet) AS (SELECT key, 0, list(r ORDER BY i), CAST(0 AS DOUBLE) FROM rows_{x} GROUP BY key
            UNION ALL SELECT key, step + 1, list_transform(m, lambda r, k: CASE WHEN k = step + 1 THEN list_transform(r, lambda e: e / m[step + 1][step + 1])
                ELSE list_transform(r, lambda e, x: e - r[step + 1] * m[step + 1][x] / m[step + 1][step + 1]) END), logdet + ln(m[step + 1][step + 1]) FROM g{x} WHERE step < (SELECT n FROM c{x})),
        inv{x} AS (SELECT g.key, g.logdet, a.i, b.i AS j, g.m[a.r][c.n + b.r] AS v FROM g{x} g, c{x} c, o{x} a, o{x} b WHERE g.step = c.n)"""


def _projected(x: str = "") -> str:
    """CTEs y, s, mm(key, i, j, v), w(key, i, w), t: what the likelihood needs of M = inv - y y'/a, for a constant mean."""
    return f"""y{x} AS (SELECT v.key, any_value(v.logdet) AS logdet, v.i, sum(v.v) AS y, sum(v.v * n.z) AS u FROM inv{x} v JOIN n ON v.j = n.i GROUP BY v.key, v.i),
        s{x} AS (SELECT y.key, any_value(y.logdet) AS logdet, sum(y.y) AS a, sum(y.u) AS zy, sum(y.u * n.z) AS zu FROM y{x} y JOIN n ON y.i = n.i GROUP BY y.key),
        mm{x} AS (SELECT v.key, v.i, v.j, v.v - p.y * q.y / s.a AS v FROM inv{x} v JOIN y{x} p ON v.key = p.key AND v.i = p.i JOIN y{x} q ON v.key = q.key AND v.j = q.i JOIN s{x} s ON v.key = s.key),
        w{x} AS (SELECT y.key, y.i, y.u - y.y * s.zy / s.a AS w FROM y{x} y JOIN s{x} s ON y.key = s.key),
        ws{x} AS (SELECT key, sum(w * w) AS ww FROM w{x} GROUP BY key), ms{x} AS (SELECT key, sum(CASE WHEN i = j THEN v END) AS trm, sum(v * v) AS trm2 FROM mm{x} GROUP BY key),
        qs{x} AS (SELECT mm.key, sum(p.w * mm.v * q.w) AS wmw FROM mm{x} mm JOIN w{x} p ON mm.key = p.key AND mm.i = p.i JOIN w{x} q ON mm.key = q.key AND mm.j = q.i GROUP BY mm.key),
        t{x} AS (SELECT s.key, s.logdet, s.a, s.zu - s.zy * s.zy / s.a AS zmz, ws.ww, ms.trm, ms.trm2, qs.wmw FROM s{x} s JOIN ws{x} ws ON s.key = ws.key JOIN ms{x} ms ON s.key = ms.key JOIN qs{x} qs ON s.key = qs.key)"""


_SCALED = "exp(-sqrt(pow((a.x0-b.x0)/s.scale,2)+pow((a.x1-b.x1)/s.scale,2)))"


def _values(name: str, values: tuple[float, ...]) -> str:
    return f"{name}_({name}) AS (VALUES {', '.join(f'({v}::DOUBLE)' for v in values)})"


def _surface(full: bool) -> str:
    if full:
        grid = f"{_values('sigma', SIGMAS)}, {_values('sigma0', SIGMA0S)}, h AS (SELECT scale, sigma, sigma0, scale || ':' || sigma || ':' || sigma0 AS key FROM scale_, sigma_, sigma0_)"
        entry = f"s.sigma * s.sigma * {_SCALED} + CASE WHEN a.i = b.i THEN s.sigma0 * s.sigma0 ELSE 0 END"
    else:
        grid = f"{_values('eta', GRID)}, h AS (SELECT scale, eta, scale || ':' || eta AS key FROM scale_, eta_)"
        entry = f"{_SCALED} + CASE WHEN a.i = b.i THEN s.eta ELSE 0 END"
    return f"WITH RECURSIVE n AS ({NAT}), {_values('scale', SCALES)}, {grid}, m AS (SELECT s.key, a.i, b.i AS j, {entry} AS v FROM n a, n b, h s), {_inverses('m')}, {_projected()}"


_PROFILE = f"""{_surface(False)}, f AS (SELECT h.scale, h.eta, {_r("-0.5 * (24 * (ln(2 * pi()) + 1 + ln(zmz / 24)) + logdet + ln(a))")} AS ell, {_r("-0.5 * trm + 0.5 * ww / (zmz / 24)")} AS dell,
    {_r("0.5 * trm2 - wmw / (zmz / 24) + ww * ww / (48 * pow(zmz / 24, 2))")} AS d2ell, {_r("sqrt(zmz / 24)")} AS sigma, {_r("sqrt(h.eta * zmz / 24)")} AS sigma0 FROM t JOIN h ON t.key = h.key)"""

#: The exponential correlation of the nations with its derivatives by both scales.
_KD = f"""p AS (SELECT a.i, b.i AS j, {DIST} AS r, pow(a.x0-b.x0,2)/pow({A0},3) AS q0, pow(a.x1-b.x1,2)/pow({A1},3) AS q1 FROM n a, n b),
    u AS (SELECT i, j, r, exp(-r) AS k, q0, q1, CASE WHEN r > 0 THEN -q0/r ELSE 0 END AS r0, CASE WHEN r > 0 THEN -q1/r ELSE 0 END AS r1 FROM p),
    kd AS (SELECT i, j, k, -k*r0 AS d0, -k*r1 AS d1, CASE WHEN r > 0 THEN k*r0*r0 - k*q0/r*(3/{A0}+r0/r) ELSE 0 END AS h00, CASE WHEN r > 0 THEN k*r0*r1 - k*q0/(r*r)*r1 ELSE 0 END AS h01,
        CASE WHEN r > 0 THEN k*r1*r1 - k*q1/r*(3/{A1}+r1/r) ELSE 0 END AS h11 FROM u)"""


def _derivatives(first: list[str], second: dict[tuple[int, int], str], entry: str) -> str:
    """CTEs up to tr(a, v), in_(a, v), tr2(a, b, v), quad(a, b, v) and sec(a, b, trace, inner) for S with these derivatives, in columns of kd."""
    firsts = " UNION ALL ".join(f"SELECT {a} AS a, i, j, {e} AS v FROM kd" for a, e in enumerate(first))
    seconds = " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, i, j, {e} AS v FROM kd" for (a, b), e in second.items())
    return f"""WITH RECURSIVE n AS ({NAT}), {_KD}, m AS (SELECT 'x' AS key, i, j, {entry} AS v FROM kd), {_inverses("m")}, {_projected()},
        sd AS ({firsts}), sm AS (SELECT sd.a, sd.i, mm.j, sum(sd.v * mm.v) AS v FROM sd JOIN mm ON sd.j = mm.i GROUP BY sd.a, sd.i, mm.j),
        sw AS (SELECT sd.a, sd.i, sum(sd.v * w.w) AS v FROM sd JOIN w ON sd.j = w.i GROUP BY sd.a, sd.i),
        tr AS (SELECT a, sum(v) AS v FROM sm WHERE i = j GROUP BY a), in_ AS (SELECT sw.a, sum(sw.v * w.w) AS v FROM sw JOIN w ON sw.i = w.i GROUP BY sw.a),
        tr2 AS (SELECT x.a, y.a AS b, sum(x.v * y.v) AS v FROM sm x JOIN sm y ON x.i = y.j AND x.j = y.i GROUP BY x.a, y.a),
        quad AS (SELECT x.a, y.a AS b, sum(x.v * mm.v * y.v) AS v FROM sw x JOIN mm ON x.i = mm.i JOIN sw y ON mm.j = y.i GROUP BY x.a, y.a),
        sd2 AS ({seconds}), sec AS (SELECT sd2.a, sd2.b, sum(sd2.v * mm.v) AS trace, sum(p.w * sd2.v * q.w) AS inside FROM sd2 JOIN mm ON sd2.i = mm.i AND sd2.j = mm.j JOIN w p ON sd2.i = p.i JOIN w q ON sd2.j = q.i GROUP BY sd2.a, sd2.b)"""


_S2, _N2 = SIGMA**2, SIGMA0**2
_EYE = "CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END"
_FULL = f"""{_derivatives(["k", _EYE, f"{_S2} * d0", f"{_S2} * d1"], {(0, 2): "d0", (0, 3): "d1", (2, 2): f"{_S2} * h00", (2, 3): f"{_S2} * h01", (3, 3): f"{_S2} * h11"}, f"{_S2} * k + {_N2} * {_EYE}")},
    e AS (SELECT -1 AS p, -1 AS q, -0.5 * (24 * ln(2 * pi()) + logdet + ln(a) + zmz) AS v FROM t UNION ALL SELECT tr.a, -1, -0.5 * tr.v + 0.5 * in_.v FROM tr JOIN in_ ON tr.a = in_.a
        UNION ALL SELECT x.a, x.b, 0.5 * x.v - q.v + coalesce(-0.5 * s.trace + 0.5 * s.inside, 0) FROM tr2 x JOIN quad q ON x.a = q.a AND x.b = q.b LEFT JOIN sec s ON x.a = s.a AND x.b = s.b WHERE x.a <= x.b)"""
_LOG = f"""{_FULL}, x(p, x, half) AS (VALUES (0, {_S2}::DOUBLE, 2.0), (1, {_N2}::DOUBLE, 2.0), (2, {A0}::DOUBLE, 1.0), (3, {A1}::DOUBLE, 1.0)),
    pr AS (SELECT p, ln(16 / 6.0 * pow(x, -5) * exp(-2 / x)) AS v, -5 / x + 2 / (x * x) AS g, 5 / (x * x) - 4 / (x * x * x) AS h FROM x WHERE p >= 2),
    l AS (SELECT -1 AS p, -1 AS q, e.v + (SELECT sum(v) FROM pr) AS v FROM e WHERE p = -1
        UNION ALL SELECT e.p, -1, e.v * x.x * ln(10) * x.half + coalesce(pr.g * x.x * ln(10), 0) FROM e JOIN x ON e.p = x.p AND e.q = -1 LEFT JOIN pr ON e.p = pr.p
        UNION ALL SELECT e.p, e.q, e.v * a.x * b.x * pow(ln(10), 2) * a.half * b.half + CASE WHEN e.p = e.q THEN d.v * a.x * pow(ln(10), 2) * a.half * a.half
            + coalesce(pr.h * a.x * a.x * pow(ln(10), 2) + pr.g * a.x * pow(ln(10), 2), 0) ELSE 0 END
        FROM e JOIN x a ON e.p = a.p JOIN x b ON e.q = b.p JOIN e d ON d.p = e.p AND d.q = -1 LEFT JOIN pr ON e.p = pr.p AND e.q = pr.p)"""
_PROF = f"""{_derivatives([_EYE, "d0", "d1"], {(1, 1): "h00", (1, 2): "h01", (2, 2): "h11"}, f"k + {ETA} * {_EYE}")}, va AS (SELECT zmz / 24 AS var FROM t),
    e AS (SELECT -1 AS p, -1 AS q, -0.5 * (24 * (ln(2 * pi()) + 1 + ln(zmz / 24)) + logdet + ln(a)) AS v FROM t UNION ALL SELECT tr.a, -1, -0.5 * tr.v + 0.5 * in_.v / va.var FROM va, tr JOIN in_ ON tr.a = in_.a
        UNION ALL SELECT x.a, x.b, 0.5 * x.v - q.v / va.var + f.v * g.v / (48 * va.var * va.var) + coalesce(-0.5 * s.trace + 0.5 * s.inside / va.var, 0)
        FROM va, tr2 x JOIN quad q ON x.a = q.a AND x.b = q.b JOIN in_ f ON x.a = f.a JOIN in_ g ON x.b = g.a LEFT JOIN sec s ON x.a = s.a AND x.b = s.b WHERE x.a <= x.b)"""
_ENTRIES = f"SELECT CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, {_r('v')} AS v FROM "


def _asymptotic() -> str:
    """Powers of N = K Q with Q = I - 1/n, as explicit matrices; the truncated products and the series of the quotient term by term."""
    eta = ", ".join(f"({k}, {e}::DOUBLE)" for k, e in enumerate(LARGE))
    steps = "".join(
        f", n{k} AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM n{k - 1} a JOIN nn b ON a.j = b.i GROUP BY a.i, b.j), v{k} AS (SELECT nn.i, sum(nn.v * v{k - 1}.v) AS v FROM nn JOIN v{k - 1} ON nn.j = v{k - 1}.i GROUP BY nn.i)" for k in (1, 2, 3)
    )
    ta = " UNION ALL ".join(f"SELECT {k} AS k, pow(-1, {k}) * (SELECT sum(a.v * q.v) FROM n{k} a JOIN q ON a.i = q.j AND a.j = q.i) / 24 AS t, pow(-1, {k}) * (SELECT sum(zq.v * v.v) FROM v{k} v JOIN zq ON v.i = zq.i) / (SELECT sum(v * v) FROM zq) AS a" for k in range(4))
    c = ["0"] * 4
    for k in range(4):
        c[k] = f"(u{k}" + "".join(f" - a{j} * {c[k - j]}" for j in range(1, k + 1)) + ")"
    terms = " + ".join(f"{c[k]} * pow(eta, -{k}) / {k}" for k in range(1, 4))
    poly = lambda x: " + ".join(f"{x}{k} * pow(eta, -{k})" for k in range(4))
    dpoly = lambda x: " - ".join(["0", *(f"{k} * {x}{k} * pow(eta, -{k} - 1)" for k in range(1, 4))])
    wide = ", ".join(f"(SELECT v FROM num WHERE k = {k}) AS u{k}, (SELECT a FROM ta WHERE k = {k}) AS a{k}" for k in range(4))
    return f"""WITH n AS ({NAT}), k AS (SELECT a.i, b.i AS j, exp(-{DIST}) AS v FROM n a, n b), q AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0 END - 1 / 25.0::DOUBLE AS v FROM n a, n b),
        nn AS (SELECT k.i, q.j, sum(k.v * q.v) AS v FROM k JOIN q ON k.j = q.i GROUP BY k.i, q.j), zq AS (SELECT q.i, sum(q.v * n.z) AS v FROM q JOIN n ON q.j = n.i GROUP BY q.i),
        n0 AS (SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END AS v FROM q), v0 AS (SELECT i, z AS v FROM n){steps}, ta AS ({ta}),
        num AS (SELECT a.k + b.k AS k, sum(a.t * b.a) - any_value(d.a * (a.k + b.k + 1)) AS v FROM ta a, ta b, ta d WHERE a.k + b.k = d.k GROUP BY a.k + b.k), wide AS (SELECT {wide}), e(k, eta) AS (VALUES {eta}),
        f AS (SELECT e.k, eta, {poly("u")} AS u, {poly("a")} AS w, {dpoly("u")} AS du, {dpoly("a")} AS dw, {terms} AS series FROM e, wide), ols AS (SELECT sum(v * v) / 24 AS var FROM zq)
        SELECT 'coefficient' AS what, CAST(k AS INTEGER) AS k, {_r("v")} AS v FROM num UNION ALL SELECT 'slope', CAST(k AS INTEGER), {_r("-24 / (2 * eta) * u / w")} FROM f
        UNION ALL SELECT 'bend', CAST(k AS INTEGER), {_r("-12 * ((du * w - u * dw) / (w * w * eta) - u / (w * eta * eta))")} FROM f
        UNION ALL SELECT 'value', CAST(k AS INTEGER), {_r("-0.5 * (24 * (ln(2 * pi()) + 1 + ln(ols.var)) + ln(25)) + 12 * series")} FROM f, ols"""


def _eigen() -> str:
    """CTEs up to ends(low, high): power iteration on K and on its inverse."""
    iterate = lambda name, source, steps: f"""l{name} AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM {source} GROUP BY i)),
        {name}(step, v) AS (SELECT 0, list_transform(range(25), lambda x: sin(x + 1.0)) UNION ALL
            SELECT step + 1, list_transform(list_transform(l.m, lambda r: list_dot_product(r, v)), lambda e: e / sqrt(list_dot_product(list_transform(l.m, lambda r: list_dot_product(r, v)), list_transform(l.m, lambda r: list_dot_product(r, v)))))
            FROM {name}, l{name} l WHERE step < {steps}),
        e{name} AS (SELECT list_dot_product(v, list_transform(l.m, lambda r: list_dot_product(r, v))) AS value FROM {name}, l{name} l WHERE step = {steps})"""  # noqa: E731
    return f"""WITH RECURSIVE n AS ({NAT}), k AS (SELECT a.i, b.i AS j, exp(-{DIST}) AS v FROM n a, n b), m AS (SELECT 'x' AS key, * FROM k), {_inverses("m")},
        {iterate("top", "k", 300)}, {iterate("low", "inv", 6000)}, ends AS (SELECT 1 / elow.value AS low, etop.value AS high FROM elow, etop)"""


_TAPERED = f"""n AS ({SUP}), kt AS (SELECT a.i, b.i AS j, exp(-sqrt(pow((a.x0-b.x0)/0.1,2)+pow((a.x1-b.x1)/0.1,2))) AS v FROM n a, n b),
    m AS (SELECT 'x' AS key, i, j, CASE WHEN v >= 0.05 THEN v ELSE 0 END + CASE WHEN i = j THEN 1.0 ELSE 0 END AS v FROM kt)"""
_SOLVED = f"WITH RECURSIVE {_TAPERED}, {_inverses('m')}, x AS (SELECT inv.i, sum(inv.v * n.z) AS u FROM inv JOIN n ON inv.j = n.i GROUP BY inv.i)"
_COV = f"n AS ({NAT}), {_KD}, m AS (SELECT 'x' AS key, i, j, {_S2} * k + {_N2} * {_EYE} AS v FROM kd)"


def _taper_derivatives() -> str:
    cols = {"s_v": M15[0], "s_d0": f"({M15[1]})*r0", "s_d1": f"({M15[1]})*r1", "s_h00": f"({M15[2]})*r0*r0+({M15[1]})*q0/r*(3/{A0}+r0/r)", "s_h01": f"({M15[2]})*r0*r1+({M15[1]})*q0/(r*r)*r1", "s_h11": f"({M15[2]})*r1*r1+({M15[1]})*q1/r*(3/{A1}+r1/r)"}
    sums = ", ".join(f"{_r(f'sum({e})' if k == 's_v' else f'coalesce(sum(CASE WHEN r > 0 THEN {e} END), 0)')} AS {k}" for k, e in cols.items())
    return f"""WITH n AS ({SUP}), p AS (SELECT a.i, {DIST} AS r, pow(a.x0-b.x0,2)/pow({A0},3) AS q0, pow(a.x1-b.x1,2)/pow({A1},3) AS q1 FROM n a, n b),
        u AS (SELECT i, r, q0, q1, CASE WHEN r > 0 THEN -q0/r END AS r0, CASE WHEN r > 0 THEN -q1/r END AS r1 FROM p WHERE {M15[0]} >= {TAPER}) SELECT i, {sums} FROM u GROUP BY i"""


def _kernel_tables() -> str:
    parts = " UNION ALL ".join(f"SELECT '{name}' AS kernel, id, x, CAST({KERNELS[name][1]} AS DOUBLE) AS d0, CAST({KERNELS[name][2]} AS DOUBLE) AS d1, CAST({KERNELS[name][3]} AS DOUBLE) AS d2 FROM t" for name in ("k_exponential", "k_square_exponential", "k_linear", "k_rational_quadratic", "k_matern_15"))
    return f"""WITH t AS (SELECT k AS id, k * (4.0::DOUBLE / 100) AS x FROM (SELECT unnest(range(101)) AS k)), u AS ({parts}),
        v AS (SELECT *, lead(d0) OVER w AS up, lag(d0) OVER w AS down FROM u WINDOW w AS (PARTITION BY kernel ORDER BY id))
        SELECT kernel, round(x, 6) AS x, {_r("d0")} AS d0, {_r("d1")} AS d1, {_r("d2")} AS d2, {_r("(up - down) / (2 * 0.04)")} AS n1, {_r("(up - 2 * d0 + down) / (0.04 * 0.04)")} AS n2 FROM v"""


def _training() -> str:
    """The best of a grid of log10 eta, refined three times: 33 values each between the neighbours of the best."""
    ctes, low, high = [f"n AS (SELECT i, x0, x1, sin(x0 * 2 * pi()) + (i * i * 7 % 11) / 5.0::DOUBLE AS z FROM ({NAT})), k AS (SELECT a.i, b.i AS j, exp(-{DIST}) AS v FROM n a, n b)"], "-4.0", "4.0"
    for level in range(4):
        base = [f"z{level} AS (SELECT unnest(range(33)) AS at_, {low} AS lo, {high} AS hi)", f"h{level} AS (SELECT CAST(at_ AS VARCHAR) AS key, lo + (hi - lo) * at_ / 32.0 AS t, (hi - lo) / 32 AS step FROM z{level})", f"m{level} AS (SELECT h.key, k.i, k.j, k.v + CASE WHEN k.i = k.j THEN pow(10, h.t) ELSE 0 END AS v FROM k, h{level} h)"]
        text = f"{_inverses(f'm{level}', f'_{level}')}, {_projected(f'_{level}')}"
        best = f"b{level} AS (SELECT h.t, h.step, -0.5 * (24 * (ln(2 * pi()) + 1 + ln(x.zmz / 24)) + x.logdet + ln(x.a)) AS ell FROM t_{level} x JOIN h{level} h ON x.key = h.key ORDER BY ell DESC LIMIT 1)"
        ctes += [*base, text, best]
        low, high = f"(SELECT t - step FROM b{level})", f"(SELECT t + step FROM b{level})"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT method, round(ell, 4) AS posterior, TRUE AS stationary FROM b3, (VALUES ('Newton-CG'), ('chandrupatla')) AS v(method)"


ORACLES: dict[str, str] = {
    "profile_surface": f"{_PROFILE} SELECT * FROM f",
    "full_surface": f"{_surface(True)} SELECT h.scale, h.sigma, h.sigma0, {_r('-0.5 * (24 * ln(2 * pi()) + logdet + ln(a) + zmz)')} AS ell FROM t JOIN h ON t.key = h.key",
    "double_profile_argmax": f"{_PROFILE} SELECT scale, eta, ell, sigma, sigma0 FROM f QUALIFY row_number() OVER (PARTITION BY scale ORDER BY ell DESC, eta) = 1",
    "full_loglik_derivatives": f"{_FULL} {_ENTRIES} e",
    "log_posterior_derivatives": f"{_LOG} {_ENTRIES} l",
    "profile_loglik_derivatives": f"{_PROF} {_ENTRIES} e",
    "asymptotic_slope": _asymptotic(),
    "beta_gls": f"""WITH RECURSIVE {_COV}, {_inverses("m")}, s AS (SELECT sum(inv.v) AS a, sum(inv.v * n.z) AS zy FROM inv JOIN n ON inv.j = n.i), e AS (SELECT 0 AS kind, -1 AS q, zy / a AS v FROM s UNION ALL SELECT 0, 0, 1 / a FROM s
        UNION ALL SELECT 1, -1, (zy + 3.0 / 0.5 / {_S2}) / (a + 1 / 0.5 / {_S2}) FROM s UNION ALL SELECT 1, 0, 1 / (a + 1 / 0.5 / {_S2}) FROM s) SELECT CAST(kind AS INTEGER) AS kind, CAST(0 AS INTEGER) AS p, CAST(q AS INTEGER) AS q, {_r("v")} AS v FROM e""",
    "cov_trace_bc": f"""WITH RECURSIVE {_COV}, {_inverses("m")}, bs AS (SELECT kd.i, inv.j, sum(kd.k * inv.v) AS v FROM kd JOIN inv ON kd.j = inv.i GROUP BY kd.i, inv.j), cs AS (SELECT a.i, inv.j, sum(inv.v) AS v FROM n a JOIN inv ON inv.i <= a.i GROUP BY a.i, inv.j)
        SELECT {_r("(SELECT sum(v) FROM bs WHERE i = j)")} AS b1, {_r("(SELECT sum(bs.v * cs.v) FROM bs JOIN cs ON bs.i = cs.j AND bs.j = cs.i)")} AS bc, {_r("(SELECT sum(k) FROM kd WHERE j >= i)")} AS p0""",
    "cov_trace_real_p": f"""WITH RECURSIVE {_COV}, {_inverses("m")}, q AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY a.i, b.j)
        SELECT {_r("(SELECT sum(v) FROM inv WHERE i = j)")} AS pm1, {_r("(SELECT sum(v * v) FROM q)")} AS p4, TRUE AS half_bounded""",
    "extreme_eigenvalues": f"{_eigen()} SELECT {_r('low')} AS low, {_r('high')} AS high FROM ends",
    "der1_bounds": f"{_eigen()}, {_values('eta', GRID)} SELECT eta, {_r('-12 * (1 / (eta + low) - 1 / (eta + high))')} AS low, {_r('12 * (1 / (eta + low) - 1 / (eta + high))')} AS high FROM ends, eta_",
    "cov_derivative_functions": f"WITH n AS ({NAT}), {_KD} SELECT "
    + ", ".join(f"{_r(f'sum(pow({_S2} * {c}, 2))')} AS sq{k}" for k, c in (("0x", "d0"), ("1x", "d1"), ("00", "h00"), ("01", "h01"), ("11", "h11")))
    + f", {_r(f'sum(CASE WHEN kd.i = kd.j THEN {_S2} * d0 END)')} AS t0, {_r(f'sum({_S2} * d0 * n.z)')} AS dot FROM kd JOIN n ON kd.j = n.i",
    "corr_taper_derivatives": _taper_derivatives(),
    "cg_solve": f"{_SOLVED} SELECT i, {_r('u')} AS u FROM x",
    "sparse_solvers": f"{_SOLVED} SELECT i, solver, {_r('u')} AS u FROM x, (VALUES ('cg'), ('minres'), ('gmres')) AS v(solver)",
    "stochastic_traceinv": f"WITH RECURSIVE {_TAPERED}, {_inverses('m')} SELECT {_r('sum(v)')} AS exact, TRUE AS within FROM inv WHERE i = j",
    "stochastic_traceinv_bc": f"""WITH RECURSIVE {_TAPERED}, {_inverses('m')}, q AS (SELECT a.i, b.j, sum(a.v * (1 + n.x0 * n.x0) * b.v) AS v FROM inv a JOIN inv b ON a.j = b.i JOIN n ON a.j = n.i GROUP BY a.i, b.j)
        SELECT {_r('sum((m.v - CASE WHEN m.i = m.j THEN 1 ELSE 0 END) * q.v)')} AS exact, TRUE AS within FROM m JOIN q ON m.i = q.j AND m.j = q.i""",
    "slq_logdet": f"WITH RECURSIVE {_TAPERED}, {_inverses('m')} SELECT {_r('any_value(logdet)')} AS exact, TRUE AS within FROM inv",
    "gp_predict_band": f"""WITH RECURSIVE n AS ({NAT}), {_KD}, m AS (SELECT 'x' AS key, i, j, k + {ETA} * {_EYE} AS v FROM kd), {_inverses("m")}, {_projected()},
        x AS (SELECT c_custkey AS t, c_acctbal / 10000 AS x0, c_nationkey / 25.0::DOUBLE AS x1 FROM customer), ks AS (SELECT b.t, a.i, exp(-{DIST}) AS v FROM n a, x b),
        f AS (SELECT ks.t, sum(ks.v * w.w) + any_value(s.zy / s.a) AS mean, 1 - sum(ks.v * y.y) AS rest, any_value(s.a) AS a FROM ks JOIN w ON ks.i = w.i JOIN y ON ks.i = y.i, s GROUP BY ks.t),
        kv AS (SELECT ks.t, inv.j, sum(ks.v * inv.v) AS v FROM ks JOIN inv ON ks.i = inv.i GROUP BY ks.t, inv.j), qf AS (SELECT kv.t, sum(kv.v * ks.v) AS q FROM kv JOIN ks ON kv.t = ks.t AND kv.j = ks.i GROUP BY kv.t),
        d AS (SELECT f.t, f.mean, sqrt(greatest(0, 1 - qf.q + f.rest * f.rest / f.a)) AS sd FROM f JOIN qf ON f.t = qf.t)
        SELECT t, {_r("mean")} AS mean, {_r("sd")} AS sd, {_r("mean - 1.959963984540054 * sd")} AS lo, {_r("mean + 1.959963984540054 * sd")} AS hi FROM d""",
    "gp_train_nation": _training(),
    "gp_train_tapered": "SELECT count(*) AS n, TRUE AS close, CAST(25 AS BIGINT) AS predicted FROM (SELECT unnest(range(400)))",
    "kernel_tables": _kernel_tables(),
    "prior_suggestions": """WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS k, 1.0::DOUBLE + n_nationkey / 10.0::DOUBLE AS a, 2.0::DOUBLE + n_nationkey / 5.0::DOUBLE AS b FROM nation)
        SELECT k, prior, round(CAST(CASE prior WHEN 'uniform' THEN a + b / 2 WHEN 'half_bounded' THEN 2 * a WHEN 'normal' THEN a WHEN 'half_normal' THEN b WHEN 'cauchy' THEN a
            WHEN 'student_t' THEN CASE WHEN a > 2 THEN sqrt(a / (a - 2)) ELSE 1 END WHEN 'gamma' THEN a / b WHEN 'erlang' THEN (k + 1) / b
            WHEN 'inverse_gamma' THEN CASE WHEN a > 1 THEN b / (a - 1) ELSE b / (a + 1) END WHEN 'beta_prime' THEN CASE WHEN b > 1 THEN a / (b - 1) ELSE 1 END END AS DOUBLE), 6) + 0.0 AS guess
        FROM t, (SELECT unnest(['uniform', 'half_bounded', 'normal', 'half_normal', 'cauchy', 'student_t', 'gamma', 'erlang', 'inverse_gamma', 'beta_prime']) AS prior)""",
    "sample_points_grid": f"""WITH l AS (SELECT k AS i, 0.2 + (k % 8) * 0.2::DOUBLE / 7 AS x0, 0.3 + (k // 8) * 0.2::DOUBLE / 7 AS x1 FROM (SELECT unnest(range(64)) AS k)
            UNION ALL SELECT 64 + k, CAST(k % 2 AS DOUBLE), CAST(k // 2 AS DOUBLE) FROM (SELECT unnest(range(4)) AS k))
        SELECT CAST(i AS BIGINT) AS i, {_r("x0")} AS x0, {_r("x1")} AS x1, {_r("sin(pi() * x0) + sin(pi() * x1)")} AS z FROM l""",
}
