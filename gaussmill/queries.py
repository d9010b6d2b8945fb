"""Registered queries of the Gaussian-process engine, each with independent SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

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
from gaussmill.sources import points as S

SCALE, ETA, DIGITS = (0.3, 0.5), 0.1, 6
GRID = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)


def rounded(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, with no negative zero: sums differ in their last digits from engine to engine."""
    return df.select(*[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes])


def one(spark: SparkSession, **values: float) -> DataFrame:
    return rounded(spark.createDataFrame([tuple(map(float, values.values()))], ", ".join(f"{k} double" for k in values)))


# scalar functions


def kernel_query(kernel: K.Kernel, spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.quantity_points(spark, sf_dir).select((F.col("x") * 2).alias("x"))
    return rounded(x.select("x", *K.kernel_columns(kernel, F.col("x"))), ("x",))


def prior_query(prior: P.Prior, spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.quantity_points(spark, sf_dir).where("x > 0")
    return rounded(x.select("x", *prior.columns(F.col("x"))), ("x",))


KERNELS = {
    "k_exponential": (K.Exponential(), "exp(-x)", "-exp(-x)", "exp(-x)"),
    "k_square_exponential": (K.SquareExponential(), "exp(-x*x/2)", "-x*exp(-x*x/2)", "(x*x-1)*exp(-x*x/2)"),
    "k_linear": (K.Linear(), "CASE WHEN abs(x)<=1 THEN 1-x ELSE 0 END", "CASE WHEN abs(x)<=1 THEN -1.0 ELSE 0 END", "0.0"),
    "k_rational_quadratic": (K.RationalQuadratic(1.2), "pow(1+x*x/2.4,-1.2)", "-x*pow(1+x*x/2.4,-2.2)", "x*x*(1+1/1.2)*pow(1+x*x/2.4,-3.2)-pow(1+x*x/2.4,-2.2)"),
    "k_matern_05": (K.Matern(0.5), "exp(-x)", "-exp(-x)", "exp(-x)"),
    "k_matern_15": (K.Matern(1.5), "(1+sqrt(3)*x)*exp(-sqrt(3)*x)", "-3*x*exp(-sqrt(3)*x)", "3*(sqrt(3)*x-1)*exp(-sqrt(3)*x)"),
    "k_matern_25": (K.Matern(2.5), "(1+sqrt(5)*x+5*x*x/3)*exp(-sqrt(5)*x)", "-5*x*(1+sqrt(5)*x)/3*exp(-sqrt(5)*x)", "5*(5*x*x-sqrt(5)*x-1)/3*exp(-sqrt(5)*x)"),
    "k_matern_limit": (K.Matern(150.0), "exp(-x*x/2)", "-x*exp(-x*x/2)", "(x*x-1)*exp(-x*x/2)"),
    "k_matern_general": (
        K.Matern(3.5), "(1+sqrt(7)*x+14*x*x/5+7*sqrt(7)*x*x*x/15)*exp(-sqrt(7)*x)", "-7*x*(1+sqrt(7)*x+7*x*x/3)/5*exp(-sqrt(7)*x)",
        "-(7/5.0)*(1+2*sqrt(7)*x+7*x*x-sqrt(7)*x-7*x*x-7*sqrt(7)*x*x*x/3)*exp(-sqrt(7)*x)",
    ),
}

#: Prior, density, derivative of the log density, its second derivative.
PRIORS = {
    "prior_uniform": (P.Uniform(0.2, 0.9), "CASE WHEN x BETWEEN 0.2 AND 0.9 THEN 1/(0.9-0.2) ELSE 0 END", "0", "0"),
    "prior_normal": (P.Normal(1.0, 3.0), "exp(-pow((x-1)/3,2)/2)/(3*sqrt(2*pi()))", "-(x-1)/9", "-1/9.0"),
    "prior_half_normal": (P.Normal(0.0, 2.0, half=True), "2*exp(-x*x/8)/(2*sqrt(2*pi()))", "-x/4", "-1/4.0"),
    "prior_cauchy": (P.Cauchy(1.0, 2.0), "1/(pi()*2*(1+pow((x-1)/2,2)))", "-2*(x-1)/(4+pow(x-1,2))", "(-2*(4+pow(x-1,2))+4*pow(x-1,2))/pow(4+pow(x-1,2),2)"),
    "prior_student_t": (P.StudentT(4.0), "gamma(2.5)/(sqrt(4*pi())*gamma(2))*pow(1+x*x/4,-2.5)", "-5*x/(4+x*x)", "(-5*(4+x*x)+10*x*x)/pow(4+x*x,2)"),
    "prior_gamma": (P.Gamma(2.0, 4.0), "16*x*exp(-4*x)", "1/x-4", "-1/(x*x)"),
    "prior_erlang": (P.Erlang(2, 4.0), "16*x*exp(-4*x)", "1/x-4", "-1/(x*x)"),
    "prior_inverse_gamma": (P.InverseGamma(4.0, 2.0), "16/6.0*pow(x,-5)*exp(-2/x)", "-5/x+2/(x*x)", "5/(x*x)-4/(x*x*x)"),
    "prior_beta_prime": (P.BetaPrime(2.0, 4.0), "20*x*pow(1+x,-6)", "1/x-6/(1+x)", "-1/(x*x)+6/pow(1+x,2)"),
}


def _r(sql: str) -> str:
    return f"round(CAST({sql} AS DOUBLE), {DIGITS}) + 0.0"


def kernel_sql(values: tuple) -> str:
    return f"WITH t AS (SELECT DISTINCT l_quantity / 50 * 2 AS x FROM lineitem) SELECT x, {_r(values[1])} AS d0, {_r(values[2])} AS d1, {_r(values[3])} AS d2 FROM t"


def prior_sql(values: tuple) -> str:
    some = lambda e: f"CASE WHEN p > 0 THEN {_r(e)} END"
    return f"""WITH t AS (SELECT DISTINCT l_quantity / 50 AS x FROM lineitem WHERE l_quantity > 0), u AS (SELECT x, CAST({values[1]} AS DOUBLE) AS p, CAST({values[2]} AS DOUBLE) AS g, CAST({values[3]} AS DOUBLE) AS h FROM t)
        SELECT x, {_r("p")} AS pdf, {_r("p*g")} AS d1, {_r("p*(g*g+h)")} AS d2, CASE WHEN p > 0 THEN {_r("ln(CASE WHEN p > 0 THEN p END)")} ELSE CAST('-inf' AS DOUBLE) END AS log_pdf,
        {some("g*x*ln(10)")} AS log_d1, {some("h*x*x*pow(ln(10),2)+g*x*pow(ln(10),2)")} AS log_d2 FROM u"""


# points as SQL

NAT = "SELECT n_nationkey AS i, n_nationkey / 25.0::DOUBLE AS x0, n_regionkey / 5.0::DOUBLE AS x1, CAST(length(n_name) AS DOUBLE) AS z FROM nation"
SUP = "SELECT s_suppkey AS i, s_acctbal / 10000 AS x0, s_nationkey / 25.0::DOUBLE AS x1, sin(s_acctbal / 10000 * pi()) + cos(s_nationkey / 25.0::DOUBLE * 7) / 5 AS z FROM supplier"
CUS = "SELECT c_custkey AS i, c_acctbal / 10000 AS x0, c_nationkey / 25.0::DOUBLE AS x1 FROM customer"
A0, A1 = SCALE
DIST = f"sqrt(pow((a.x0-b.x0)/{A0},2)+pow((a.x1-b.x1)/{A1},2))"
#: Matern 3/2, its slope and bend.
M15 = ("(1+sqrt(3)*r)*exp(-sqrt(3)*r)", "-3*r*exp(-sqrt(3)*r)", "3*(sqrt(3)*r-1)*exp(-sqrt(3)*r)")


def basis_query(basis: B.Basis, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.design_matrix(S.supplier_points(spark, sf_dir).select("i", "x0", "x1"), basis).drop("x0", "x1"))


def _custom(x: list) -> list:
    return [F.exp(-x[0]), x[0] * x[1]]


BASES = {
    "basis_polynomial": (B.Basis(2), ["1.0", "x0", "x0*x0", "x1", "x0*x1", "x1*x1"]),
    "basis_trigonometric": (B.Basis(None, (1.0, 2.0)), [f"{f}({x}*{c})" for c in (1.0, 2.0) for x in ("x0", "x1") for f in ("sin", "cos")]),
    "basis_hyperbolic": (B.Basis(None, (), (0.5,)), [f"(exp({x}*0.5){s}exp(-{x}*0.5))/2" for x in ("x0", "x1") for s in "-+"]),
    "basis_custom": (B.Basis(0, func=_custom), ["1.0", "exp(-x0)", "x0*x1"]),
}


def basis_orthonormal_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gram matrix of an orthonormalised basis."""
    frame = B.orthonormalized(B.design_matrix(S.supplier_points(spark, sf_dir), B.Basis(1)))
    g = B.gram(frame, ["b0", "b1", "b2"], ["b0", "b1", "b2"])
    return rounded(spark.createDataFrame([(i, j, float(g[i, j])) for i in range(3) for j in range(3)], "p int, q int, v double"))


def points_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.generate_data(S.lattice(spark, 30, 2)))


# correlation


def row_sums(upper: DataFrame) -> DataFrame:
    names = [c for c in upper.columns if c not in ("i", "j")]
    return R.mirrored(upper).groupBy("i").agg(*[F.sum(c).alias(f"s_{c}") for c in names])


def corr_derivatives_rowsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row sums of K and all its derivatives by the scale, Matern 3/2."""
    return rounded(Z.row_sums(S.supplier_points(spark, sf_dir), SCALE, K.Matern(1.5), order=2).drop("n"))


def k_exponential_rowsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(row_sums(R.correlation(S.supplier_points(spark, sf_dir), SCALE, K.Exponential())))


def cross_corr_rowsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Z.row_sums(S.supplier_points(spark, sf_dir), SCALE, K.Exponential(), tests=S.customer_points(spark, sf_dir)).drop("n"))


TAPER = 0.3


def corr_taper_rowsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Z.row_sums(S.customer_points(spark, sf_dir), 0.1, K.Exponential(), threshold=TAPER).drop("n"))


def cross_taper_rowsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Z.row_sums(S.supplier_points(spark, sf_dir), 0.1, K.Exponential(), threshold=TAPER, tests=S.customer_points(spark, sf_dir)).select("t", "s_v", "n"))


def corr_taper_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = S.customer_points(spark, sf_dir)
    return rounded(R.densities(Z.pair_count(pts, 0.1, K.Exponential(), TAPER), pts.count()))


def taper_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, tau=R.taper_threshold(0.01, S.customer_points(spark, sf_dir).count(), 2, SCALE, K.Exponential()))


# covariance


def _cov(spark: SparkSession, sf_dir: str, points=S.nation_points, **more) -> C.Covariance:
    return C.Covariance(points(spark, sf_dir), sigma=2.0, sigma0=0.7, scale=SCALE, kernel=K.Exponential(), **more)


def cov_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cov(spark, sf_dir)
    return one(spark, p0=c.trace(p=0), p1=c.trace(), p2=c.trace(p=2), p3=c.trace(p=3))


def cov_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cov(spark, sf_dir)
    once = c.dot(c.points, ["z"]).withColumnRenamed("z", "p1")
    return rounded(once.join(c.dot(c.points, ["z"], p=2).withColumnRenamed("z", "p2"), "i"))


def cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cov(spark, sf_dir).get_matrix())


def auto_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cov(spark, sf_dir).auto_covariance(S.supplier_points(spark, sf_dir)).groupBy("i").agg(F.sum("v").alias("s_v")))


def cross_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cov(spark, sf_dir).cross_covariance(S.supplier_points(spark, sf_dir)).groupBy("t").agg(F.sum("v").alias("s_v")))


def cov_logdet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cov(spark, sf_dir)
    return one(spark, p1=c.logdet(), p2=c.logdet(p=2))


def cov_traceinv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cov(spark, sf_dir)
    return one(spark, p1=c.traceinv(), p2=c.traceinv(p=2))


def cov_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cov(spark, sf_dir)
    return rounded(c.solve(c.points, ["z"]).withColumnRenamed("z", "u"))


def spectrum_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the eigenvalues of K and of their squares."""
    values = _cov(spark, sf_dir).eigenvalues()
    return rounded(values.agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2")))


# likelihood and regression


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in GRID], "eta double")


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.spectrum(S.nation_points(spark, sf_dir), K.Exponential(), SCALE, B.Basis(0))


def profile_loglik_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.profile_grid(_spectrum(spark, sf_dir), _grid(spark)), ("eta",))


def profile_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.argmax(H.profile_grid(_spectrum(spark, sf_dir), _grid(spark))), ("eta",))


def ols_sigma0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinary least squares on a constant and x0: coefficients and residual deviation."""
    frame = S.supplier_points(spark, sf_dir).select(F.lit(1.0).alias("b0"), F.col("x0").alias("b1"), "z")
    import numpy as np

    g = B.gram(frame, ["b0", "b1", "z"], ["b0", "b1", "z"])
    beta = np.linalg.solve(g[:2, :2], g[:2, 2])
    rest = g[2, 2] - beta @ g[:2, 2]
    return one(spark, beta0=beta[0], beta1=beta[1], sigma0=math.sqrt(rest / (g[0, 0] - 2)))


def _process() -> G.GaussianProcess:
    return G.GaussianProcess(kernel=K.Exponential(), scale=SCALE)


def gp_train_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _process().train(S.supplier_points(spark, sf_dir)).summary()


def gp_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_process().train(S.supplier_points(spark, sf_dir), method="chandrupatla").convergence())


def _fixed_model(spark: SparkSession, sf_dir: str) -> G.GPModel:
    """A model with given hyperparameters: sigma 1, sigma0 sqrt(0.1), constant mean by generalised least squares."""
    pts = S.nation_points(spark, sf_dir)
    c = C.Covariance(pts, sigma=1.0, sigma0=math.sqrt(ETA), scale=SCALE, kernel=K.Exponential())
    ones = pts.withColumn("o", F.lit(1.0))
    y = c.solve(ones, ["o"]).withColumnRenamed("o", "y")
    row = y.join(ones, "i").agg(F.sum(F.col("y") * F.col("z")), F.sum("y")).first()
    return G.GPModel(_process(), pts, {"sigma": 1.0, "sigma0": math.sqrt(ETA), "scale": list(SCALE), "beta": [row[0] / row[1]], "c": [1 / row[1]], "n": 25})


def gp_predict_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fixed_model(spark, sf_dir).predict(S.supplier_points(spark, sf_dir).drop("z")))


def session_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaussmill.runtime import info

    return info(spark)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: partial(kernel_query, v[0]) for k, v in KERNELS.items()},
    **{k: partial(prior_query, v[0]) for k, v in PRIORS.items()},
    **{k: partial(basis_query, v[0]) for k, v in BASES.items()},
    **{
        f.__name__: f
        for f in (
            basis_orthonormal_gram, points_lattice, k_exponential_rowsum, corr_derivatives_rowsum, cross_corr_rowsum, corr_taper_rowsum, cross_taper_rowsum, corr_taper_stats, taper_threshold,
            cov_traces, cov_dot, cov_matrix, auto_covariance, cross_covariance, cov_logdet, cov_traceinv, cov_solve, spectrum_sums,
            profile_loglik_grid, profile_argmax, ols_sigma0, gp_train_summary, gp_convergence, gp_predict_mean, session_info,
        )
    },
}

_KNAT = f"n AS ({NAT}), k AS (SELECT a.i, b.i AS j, exp(-{DIST}) AS v FROM n a, n b)"
_SNAT = f"{_KNAT}, s AS (SELECT i, j, 4 * v + CASE WHEN i = j THEN 0.7 * 0.7 ELSE 0 END AS v FROM k)"


def _jordan(matrix: str, right: str, upto: int = 25) -> str:
    """A recursive table g(step, rows, logdet): Gauss-Jordan elimination of [matrix | right] as a list of rows, pivot by pivot."""
    return f"""g(step, m, logdet) AS (
        SELECT 0, (SELECT list(row ORDER BY i) FROM (SELECT q.i, list_concat(list(q.v ORDER BY q.j), any_value(y.y)) AS row FROM {matrix} q JOIN {right} y ON q.i = y.i GROUP BY q.i)), CAST(0 AS DOUBLE)
        UNION ALL
        SELECT step + 1,
            list_transform(m, lambda r, k: CASE WHEN k = step + 1 THEN list_transform(r, lambda e: e / m[step + 1][step + 1])
                ELSE list_transform(r, lambda e, c: e - r[step + 1] * m[step + 1][c] / m[step + 1][step + 1]) END),
            logdet + ln(m[step + 1][step + 1])
        FROM g WHERE step < {upto})"""


_ID = "y AS (SELECT a.i, list(CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0 END ORDER BY b.i) AS y FROM n a, n b GROUP BY a.i)"
_ZY = "y AS (SELECT i, [z] AS y FROM n)"
_OZ = "y AS (SELECT i, [z, 1.0::DOUBLE] AS y FROM n)"
_E = f"e AS (SELECT i, j, v + CASE WHEN i = j THEN {ETA} ELSE 0 END AS v FROM k)"


def _taper(a: str, b: str) -> str:
    return f"p AS (SELECT a.i, b.i AS t, exp(-sqrt(pow((a.x0-b.x0)/0.1,2)+pow((a.x1-b.x1)/0.1,2))) AS v FROM ({a}) a, ({b}) b), q AS (SELECT * FROM p WHERE v >= {TAPER})"


def _derivative_sql() -> str:
    sq = {0: f"pow(a.x0-b.x0,2)/pow({A0},3)", 1: f"pow(a.x1-b.x1,2)/pow({A1},3)"}
    cols = {"s_v": M15[0], "s_d0": f"({M15[1]})*r0", "s_d1": f"({M15[1]})*r1", "s_h00": f"({M15[2]})*r0*r0+({M15[1]})*q0/r*(3/{A0}+r0/r)", "s_h01": f"({M15[2]})*r0*r1+({M15[1]})*q0/(r*r)*r1", "s_h11": f"({M15[2]})*r1*r1+({M15[1]})*q1/r*(3/{A1}+r1/r)"}
    sums = ", ".join(f"{_r(f'sum({e})' if k == 's_v' else f'coalesce(sum(CASE WHEN r > 0 THEN {e} END), 0)')} AS {k}" for k, e in cols.items())
    return f"""WITH n AS ({SUP}), p AS (SELECT a.i, {DIST} AS r, {sq[0]} AS q0, {sq[1]} AS q1 FROM n a, n b),
        u AS (SELECT i, r, q0, q1, CASE WHEN r > 0 THEN -q0/r END AS r0, CASE WHEN r > 0 THEN -q1/r END AS r1 FROM p) SELECT i, {sums} FROM u GROUP BY i"""


def _profile_sql() -> str:
    """Everything from inverses: for each eta, Gauss-Jordan of [K + eta I | I]."""
    etas = ", ".join(f"({e}::DOUBLE)" for e in GRID)
    return f"""WITH RECURSIVE {_KNAT}, t(eta) AS (VALUES {etas}),
        rows_ AS (SELECT t.eta, k.i, list_concat(list(k.v + CASE WHEN k.i = k.j THEN t.eta ELSE 0 END ORDER BY k.j), list(CASE WHEN k.i = k.j THEN 1.0::DOUBLE ELSE 0 END ORDER BY k.j)) AS r FROM k, t GROUP BY t.eta, k.i),
        g(eta, step, m, logdet) AS (SELECT eta, 0, list(r ORDER BY i), CAST(0 AS DOUBLE) FROM rows_ GROUP BY eta
        UNION ALL SELECT eta, step + 1, list_transform(m, lambda r, k: CASE WHEN k = step + 1 THEN list_transform(r, lambda e: e / m[step + 1][step + 1])
                ELSE list_transform(r, lambda e, c: e - r[step + 1] * m[step + 1][c] / m[step + 1][step + 1]) END), logdet + ln(m[step + 1][step + 1]) FROM g WHERE step < 25),
        inv AS (SELECT g.eta, g.logdet, a.i, b.i AS j, g.m[CAST(a.i AS INTEGER) + 1][26 + CAST(b.i AS INTEGER)] AS v FROM g, n a, n b WHERE g.step = 25),
        y AS (SELECT v.eta, any_value(v.logdet) AS logdet, v.i, sum(v.v) AS y, sum(v.v * n.z) AS u, any_value(CASE WHEN v.i = v.j THEN v.v END) AS d FROM inv v JOIN n ON v.j = n.i GROUP BY v.eta, v.i),
        s AS (SELECT y.eta, any_value(y.logdet) AS logdet, sum(y.y) AS a, sum(y.u) AS zy, sum(n.z * y.u) AS zu, sum(y.y * y.y) AS yy FROM y JOIN n ON y.i = n.i GROUP BY y.eta),
        tr AS (SELECT eta, sum(v) AS t FROM inv WHERE i = j GROUP BY eta),
        w AS (SELECT y.eta, sum(pow(y.u - y.y * s.zy / s.a, 2)) AS ww FROM y JOIN s ON y.eta = s.eta GROUP BY y.eta),
        f AS (SELECT s.eta, s.logdet, s.a, (s.zu - s.zy * s.zy / s.a) / 24 AS var, tr.t - s.yy / s.a AS trm, w.ww FROM s JOIN tr ON s.eta = tr.eta JOIN w ON s.eta = w.eta),
        o AS (SELECT eta, {_r("-0.5 * 24 * (ln(2 * pi()) + 1 + ln(var)) - 0.5 * logdet - 0.5 * ln(a)")} AS ell, {_r("-0.5 * (trm - ww / var)")} AS dell, {_r("sqrt(var)")} AS sigma, {_r("sqrt(eta * var)")} AS sigma0 FROM f)"""


ORACLES: dict[str, str] = {
    **{k: kernel_sql(v) for k, v in KERNELS.items()},
    **{k: prior_sql(v) for k, v in PRIORS.items()},
    **{k: f"WITH n AS ({SUP}) SELECT i, " + ", ".join(f"{_r(e)} AS b{c}" for c, e in enumerate(v[1])) + " FROM n" for k, v in BASES.items()},
    "basis_orthonormal_gram": "SELECT CAST(a.p AS INTEGER) AS p, CAST(b.p AS INTEGER) AS q, CASE WHEN a.p = b.p THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM (SELECT unnest(range(3)) AS p) a, (SELECT unnest(range(3)) AS p) b",
    "points_lattice": f"SELECT k AS i, {_r('(k % 30) / 29.0::DOUBLE')} AS x0, {_r('(k // 30) / 29.0::DOUBLE')} AS x1, {_r('sin(pi() * (k % 30) / 29) + sin(pi() * (k // 30) / 29)')} AS z FROM (SELECT unnest(range(900)) AS k)",
    "k_exponential_rowsum": f"WITH n AS ({SUP}) SELECT a.i, {_r(f'sum(exp(-{DIST}))')} AS s_v FROM n a, n b GROUP BY a.i",
    "corr_derivatives_rowsum": _derivative_sql(),
    "cross_corr_rowsum": f"SELECT b.i AS t, {_r(f'sum(exp(-{DIST}))')} AS s_v FROM ({SUP}) a, ({CUS}) b GROUP BY b.i",
    "corr_taper_rowsum": f"WITH {_taper(CUS, CUS)} SELECT i, {_r('sum(v)')} AS s_v FROM q GROUP BY i",
    "cross_taper_rowsum": f"WITH {_taper(SUP, CUS)} SELECT t, {_r('sum(v)')} AS s_v, count(*) AS n FROM q GROUP BY t",
    "corr_taper_stats": f"WITH {_taper(CUS, CUS)}, c AS (SELECT count(*) AS n FROM customer) SELECT count(*) AS nnz, {_r('count(*) / pow(any_value(c.n), 2)')} AS density, {_r('count(*) / any_value(c.n)::DOUBLE')} AS average_row_nnz FROM q, c",
    "taper_threshold": f"SELECT {_r(f'exp(-sqrt(0.01 * count(*) / (pi() * {A0} * {A1}) / pi()) / (sqrt(count(*)) - 1))')} AS tau FROM customer",
    "cov_traces": f"""WITH {_SNAT}, q AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM s a JOIN s b ON a.j = b.i GROUP BY a.i, b.j)
        SELECT 25.0::DOUBLE AS p0, (SELECT {_r("sum(v)")} FROM s WHERE i = j) AS p1, (SELECT {_r("sum(v * v)")} FROM s) AS p2, (SELECT {_r("sum(s.v * q.v)")} FROM s JOIN q ON s.i = q.j AND s.j = q.i) AS p3""",
    "cov_dot": f"WITH {_SNAT}, a AS (SELECT s.i, sum(s.v * n.z) AS y FROM s JOIN n ON s.j = n.i GROUP BY s.i), b AS (SELECT s.i, sum(s.v * a.y) AS y FROM s JOIN a ON s.j = a.i GROUP BY s.i) SELECT CAST(a.i AS BIGINT) AS i, {_r('a.y')} AS p1, {_r('b.y')} AS p2 FROM a JOIN b ON a.i = b.i",
    "cov_matrix": f"WITH {_SNAT} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {_r('v')} AS v FROM s WHERE i <= j",
    "auto_covariance": f"WITH n AS ({SUP}) SELECT a.i, {_r(f'sum(4 * exp(-{DIST}))')} AS s_v FROM n a, n b WHERE a.i <= b.i GROUP BY a.i",
    "cross_covariance": f"SELECT b.i AS t, {_r(f'sum(4 * exp(-{DIST}))')} AS s_v FROM ({NAT}) a, ({SUP}) b GROUP BY b.i",
    "cov_logdet": f"WITH RECURSIVE {_SNAT}, {_ZY}, {_jordan('s', 'y')} SELECT {_r('logdet')} AS p1, {_r('2 * logdet')} AS p2 FROM g WHERE step = 25",
    "cov_traceinv": f"""WITH RECURSIVE {_SNAT}, {_ID}, {_jordan("s", "y")}, v AS (SELECT a.i, b.i AS j, g.m[CAST(a.i AS INTEGER) + 1][26 + CAST(b.i AS INTEGER)] AS v FROM g, n a, n b WHERE g.step = 25)
        SELECT {_r("sum(CASE WHEN i = j THEN v END)")} AS p1, {_r("sum(v * v)")} AS p2 FROM v""",
    "cov_solve": f"WITH RECURSIVE {_SNAT}, {_ZY}, {_jordan('s', 'y')} SELECT CAST(n.i AS BIGINT) AS i, {_r('g.m[CAST(n.i AS INTEGER) + 1][26]')} AS u FROM g, n WHERE g.step = 25",
    "spectrum_sums": f"WITH {_KNAT} SELECT {_r('sum(CASE WHEN i = j THEN v END)')} AS s1, {_r('sum(v * v)')} AS s2 FROM k",
    "ols_sigma0": f"""WITH n AS ({SUP}), s AS (SELECT count(*)::DOUBLE AS n, sum(x0) AS x, sum(x0*x0) AS xx, sum(z) AS z, sum(x0*z) AS xz, sum(z*z) AS zz FROM n),
        b AS (SELECT *, (n*xz - x*z) / (n*xx - x*x) AS b1 FROM s), c AS (SELECT *, (z - b1*x) / n AS b0 FROM b)
        SELECT {_r("b0")} AS beta0, {_r("b1")} AS beta1, {_r("sqrt((zz - b0*z - b1*xz) / (n - 2))")} AS sigma0 FROM c""",
    "profile_loglik_grid": f"{_profile_sql()} SELECT * FROM o",
    "profile_argmax": f"{_profile_sql()} SELECT * FROM o ORDER BY ell DESC, eta LIMIT 1",
    "gp_predict_mean": f"""WITH RECURSIVE {_KNAT}, {_E}, {_OZ}, {_jordan("e", "y")}, u AS (SELECT n.i, n.x0, n.x1, n.z, g.m[CAST(n.i AS INTEGER) + 1][26] AS u, g.m[CAST(n.i AS INTEGER) + 1][27] AS y FROM g, n WHERE g.step = 25),
        c AS (SELECT sum(y * z) / sum(y) AS beta FROM u), a AS (SELECT u.*, u.u - c.beta * u.y AS w FROM u, c), b AS ({SUP})
        SELECT b.i AS t, {_r(f"any_value(c.beta) + sum(a.w * exp(-{DIST}))")} AS mean FROM a, b, c GROUP BY b.i""",
}
