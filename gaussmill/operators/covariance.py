"""Covariance S = sigma^2 K + sigma0^2 I, its functions, and the solvers behind them.

Dense work of up to `MOST_DENSE` points runs as one numpy task (`local`), and
inverses and determinants of more points on strips of rows (`strips`); traces
and products are aggregates over matrix entries; larger sparse systems are
solved by conjugate gradients on DataFrames, and their traces and determinants
estimated from random probes that depend only on row numbers and a seed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaussmill.functions.basis import coordinates
from gaussmill.functions.kernels import Kernel, Matern
from gaussmill.operators.pairs import WEIGHT, correlation, located, mirrored, scales, taper_threshold
from gaussmill.operators import envelope, matrix_free, solvers, strips
from gaussmill.operators.solvers import Packed
from gaussmill.operators.sums import pair_count
from gaussmill.runtime import Scratch, checkpointed, ship_package

MOST_DENSE, LARGE_ETA = 3000, 1e16
METHODS = ("eigenvalue", "cholesky", "hutchinson", "slq")


def local(frame: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = MOST_DENSE) -> DataFrame:
    """Run numpy on all rows in one task, refusing more than `most` of them."""
    ship_package(frame.sparkSession)

    def guarded(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError(f"{len(rows)} points are too many for a dense factorisation (at most {most}); taper the kernel and use an iterative method")
        return work(rows.sort_values("i", kind="stable").reset_index(drop=True))

    def gathered(parts):
        held = [p for p in parts if len(p)]
        if held:
            yield guarded(pd.concat(held, ignore_index=True))

    return frame.limit(most + 1).coalesce(1).mapInPandas(gathered, schema)


def matrix(kernel: Kernel, x: np.ndarray, scale: list[float], y: np.ndarray | None = None, threshold: float | None = None) -> np.ndarray:
    """K of rows of x (and y) in numpy."""
    y = x if y is None else y
    total = np.zeros((len(x), len(y)))
    for k, s in enumerate(scale):
        total += ((x[:, k, None] - y[None, :, k]) / s) ** 2
    v = kernel(np.sqrt(total))
    return v if threshold is None else np.where(v >= threshold, v, 0.0)


def matrix_derivatives(kernel: Kernel, x: np.ndarray, scale: list[float], order: int) -> dict[tuple[int, ...], np.ndarray]:
    """K and its derivatives by scales in numpy, keyed by the dimensions: (), (p,), (p, q)."""
    delta = [(x[:, k, None] - x[None, :, k]) ** 2 for k in range(len(scale))]
    r = np.sqrt(sum(d / s**2 for d, s in zip(delta, scale, strict=True)))
    off = r > 0
    safe = np.where(off, r, 1.0)
    out = {(): kernel(r)}
    if order:
        first = kernel(safe, 1)
        square = [d / s**3 for d, s in zip(delta, scale, strict=True)]
        slope = [-q / safe for q in square]
        for p in range(len(scale)):
            out[(p,)] = np.where(off, first * slope[p], 0.0)
    if order > 1:
        second = kernel(safe, 2)
        for p in range(len(scale)):
            for q in range(p, len(scale)):
                bend = square[p] / safe * (3 / scale[p] + slope[p] / safe) if p == q else square[p] / safe**2 * slope[q]
                out[(p, q)] = out[(q, p)] = np.where(off, second * slope[p] * slope[q] + first * bend, 0.0)
    return out


def product(upper: DataFrame, vector: DataFrame, names: list[str], whole: bool = False) -> DataFrame:
    """K v for the columns `names` of rows (i, ...): each stored entry serves both triangles, and rows are summed before the shuffle.

    With `whole`, the entries are of both triangles already.
    """
    full = upper if whole else mirrored(upper.select("i", "j", "v"))
    moved = full.join(vector.withColumnRenamed("i", "j"), "j")
    return moved.groupBy("i").agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in names])


def shifted_product(upper: DataFrame, vector: DataFrame, names: list[str], eta: float, whole: bool = False) -> DataFrame:
    kv = product(upper, vector, names, whole).select("i", *[F.col(c).alias(f"k_{c}") for c in names])
    return vector.join(kv, "i", "left").select("i", *[(F.coalesce(f"k_{c}", F.lit(0.0)) + eta * F.col(c)).alias(c) for c in names])


def conjugate_gradient(upper: DataFrame, rhs: DataFrame, names: list[str], eta: float, tol: float = 1e-6, most: int = 1000, packed: int = solvers.MOST_ENTRIES) -> DataFrame:
    """(K + eta I) u = rhs for several right sides at once; only one number per side reaches the driver in each step.

    A matrix of at most `packed` entries takes its steps in one task instead, and may be indefinite there.

    Stops when every residual is below tol times its right side's norm, and
    raises if that does not happen within `most` steps.
    """
    held, steps = Scratch(rhs.sparkSession), Scratch(rhs.sparkSession)
    upper = held.written(upper.select("i", "j", "v"))
    if upper.count() <= packed:
        work = lambda m, ids, y: pd.DataFrame({"i": ids, **{c: v for c, v in zip(names, solvers.solve_symmetric(m, eta, y, "cg", tol).T, strict=True)}})
        out = steps.written(solvers.packed_task(upper, rhs, names, work, "i long, " + ", ".join(f"{c} double" for c in names), packed))
        held.keep_last(0)
        return out
    upper = held.written(mirrored(upper))
    state = rhs.select("i", *[F.lit(0.0).alias(f"u_{c}") for c in names], *[F.col(c).cast("double").alias(f"r_{c}") for c in names], *[F.col(c).cast("double").alias(f"p_{c}") for c in names])
    state = steps.written(state)
    dot = lambda a, b: [F.sum(F.col(f"{a}_{c}") * F.col(f"{b}_{c}")) for c in names]
    first = rr = np.array(state.agg(*dot("r", "r")).first(), float)
    for _ in range(most):
        if (rr <= tol * tol * first).all():
            held.keep_last(0)
            return state.select("i", *[F.col(f"u_{c}").alias(c) for c in names])
        ap = shifted_product(upper, state.select("i", *[F.col(f"p_{c}") for c in names]), [f"p_{c}" for c in names], eta, True)
        both = steps.written(state.join(ap.select("i", *[F.col(f"p_{c}").alias(f"q_{c}") for c in names]), "i"))
        pq = np.array(both.agg(*dot("p", "q")).first(), float)
        if (pq[rr > tol * tol * first] <= 0).any():
            raise solvers.NotDefinite("the matrix is not positive definite; conjugate gradients do not serve it")
        step = np.where(pq > 0, rr / np.where(pq > 0, pq, 1.0), 0.0)
        moved = both.select("i", *[(F.col(f"u_{c}") + float(a) * F.col(f"p_{c}")).alias(f"u_{c}") for c, a in zip(names, step, strict=True)], *[(F.col(f"r_{c}") - float(a) * F.col(f"q_{c}")).alias(f"r_{c}") for c, a in zip(names, step, strict=True)], *[F.col(f"p_{c}") for c in names])
        new = np.array(moved.agg(*dot("r", "r")).first(), float)
        grow = np.where(rr > 0, new / np.where(rr > 0, rr, 1.0), 0.0)
        state = steps.written(moved.select("i", *[F.col(f"u_{c}") for c in names], *[F.col(f"r_{c}") for c in names], *[(F.col(f"r_{c}") + float(g) * F.col(f"p_{c}")).alias(f"p_{c}") for c, g in zip(names, grow, strict=True)]))
        steps.keep_last(1)
        rr = new
    raise ArithmeticError("conjugate gradients did not converge; the tapered matrix may not be positive definite")


def probes(points: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """Rows (i, s0, s1, ...) of random signs that depend on i, the probe and the seed alone."""
    return points.select("i", *[(F.lit(1.0) - 2.0 * F.pmod(F.xxhash64("i", F.lit(k), F.lit(seed)), F.lit(2))).alias(f"s{k}") for k in range(count)])


def hutchinson_traceinv(upper: DataFrame, points: DataFrame, eta: float, count: int = 20, seed: int = 0, tol: float = 1e-6, p: int = 1, B: DataFrame | None = None, C: DataFrame | None = None, solve: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> tuple[float, float]:
    """tr M^-p, tr B M^-p or tr B M^-p C M^-p with M = K + eta I, and its standard error; B and C are rows (i, j, v) of whole matrices.

    M^-1 is applied by `solve` if given, and by conjugate gradients on `upper` otherwise.
    """
    names = [f"s{k}" for k in range(count)]
    s = checkpointed(probes(points, count, seed))

    def times(entries: DataFrame, vector: DataFrame) -> DataFrame:
        """Rows that hold no entry give zero."""
        found = product(entries, vector, names, True).select("i", *[F.col(c).alias(f"k_{c}") for c in names])
        return s.select("i").join(found, "i", "left").select("i", *[F.coalesce(f"k_{c}", F.lit(0.0)).alias(c) for c in names])

    u = s
    for k in range(2 * p if C is not None else p):
        y = times(C, u) if C is not None and k == p else u
        u = solve(y, names) if solve is not None else conjugate_gradient(upper, y, names, eta, tol)
    u = u if B is None else times(B, u)
    both = s.join(u.select("i", *[F.col(c).alias(f"u_{c}") for c in names]), "i")
    got = np.array(both.agg(*[F.sum(F.col(c) * F.col(f"u_{c}")) for c in names]).first(), float)
    return float(got.mean()), float(got.std(ddof=1) / math.sqrt(count)) if count > 1 else math.inf


def slq_logdet(upper: DataFrame, points: DataFrame, eta: float, count: int = 20, degree: int = 20, seed: int = 0, function: Callable = np.log) -> tuple[float, float]:
    """tr f(K + eta I), f the logarithm by default, by stochastic Lanczos quadrature; and its standard error."""
    held, steps = Scratch(points.sparkSession), Scratch(points.sparkSession)
    upper = held.written(mirrored(upper.select("i", "j", "v")))
    names = [f"s{k}" for k in range(count)]
    n = points.count()
    root = math.sqrt(n)
    q = steps.written(probes(points, count, seed).select("i", *[(F.col(c) / root).alias(c) for c in names]))
    before, alphas, betas = None, [], []
    for step in range(min(degree, n)):
        w = shifted_product(upper, q, names, eta, True).select("i", *[F.col(c).alias(f"w_{c}") for c in names])
        both = q.join(w, "i")
        if before is not None:
            both = both.join(before, "i").select("i", *names, *[(F.col(f"w_{c}") - float(b) * F.col(f"b_{c}")).alias(f"w_{c}") for c, b in zip(names, betas[-1], strict=True)])
        both = steps.written(both)
        alpha = np.array(both.agg(*[F.sum(F.col(c) * F.col(f"w_{c}")) for c in names]).first(), float)
        alphas.append(alpha)
        rest = both.select("i", *names, *[(F.col(f"w_{c}") - float(a) * F.col(c)).alias(f"w_{c}") for c, a in zip(names, alpha, strict=True)])
        beta = np.sqrt(np.array(rest.agg(*[F.sum(F.col(f"w_{c}") * F.col(f"w_{c}")) for c in names]).first(), float))
        betas.append(beta)
        if (beta < 1e-12).any() or step == min(degree, n) - 1:
            break
        before = rest.select("i", *[F.col(c).alias(f"b_{c}") for c in names])
        q = steps.written(rest.select("i", *[(F.col(f"w_{c}") / float(b)).alias(c) for c, b in zip(names, beta, strict=True)]))
        steps.keep_last(4)
    held.keep_last(0)
    steps.keep_last(0)
    got = []
    for k in range(count):
        t = np.diag([a[k] for a in alphas]) + np.diag([b[k] for b in betas[: len(alphas) - 1]], 1) + np.diag([b[k] for b in betas[: len(alphas) - 1]], -1)
        lam, vec = np.linalg.eigh(t)
        got.append(n * float((vec[0] ** 2 * function(lam)).sum()))
    return float(np.mean(got)), float(np.std(got, ddof=1) / math.sqrt(count)) if count > 1 else math.inf


def slq_unstored(product: Callable[[np.ndarray], np.ndarray], signs: np.ndarray, degree: int, function: Callable = np.log) -> tuple[float, float]:
    """`slq_logdet` with products of columns in the driver."""
    (n, count), alphas, betas = signs.shape, [], []
    q, before = signs / math.sqrt(n), np.zeros(signs.shape)
    for step in range(min(degree, n)):
        w = product(q) - (betas[-1] * before if betas else 0.0)
        alphas.append((q * w).sum(axis=0))
        w = w - alphas[-1] * q
        beta = np.linalg.norm(w, axis=0)
        if (beta < 1e-12).any() or step == min(degree, n) - 1:
            break
        betas.append(beta)
        q, before = w / beta, q
    got = []
    for k in range(count):
        off = [b[k] for b in betas]
        lam, vec = np.linalg.eigh(np.diag([a[k] for a in alphas]) + np.diag(off, 1) + np.diag(off, -1))
        got.append(n * float((vec[0] ** 2 * function(lam)).sum()))
    return float(np.mean(got)), float(np.std(got, ddof=1) / math.sqrt(count)) if count > 1 else math.inf


@dataclass(frozen=True)
class Covariance:
    """Covariance of a point frame (i, x0, ...).  `derivative` is (), (p,) or (p, q): dimensions of the scale."""

    points: DataFrame
    sigma: float | None = None
    sigma0: float | None = None
    scale: object = 1.0
    kernel: Kernel = field(default_factory=Matern)
    kernel_threshold: float | None = None
    sparse: bool = False
    density: float = 1e-3
    options: dict = field(default_factory=lambda: {"method": "cholesky"})
    tol: float = 1e-8

    def __post_init__(self):
        if not isinstance(self.tol, float) or self.tol < 0:
            raise ValueError("tol is a float of zero or more")
        for s in (self.sigma, self.sigma0):
            if s is not None and (isinstance(s, bool) or not isinstance(s, int | float) or s < 0):
                raise ValueError("sigmas are numbers of zero or more")
        if self.options.get("method", "cholesky") not in METHODS:
            raise ValueError(f"methods are {METHODS}")
        if self.sparse and self.kernel_threshold is None:  # once, so that all matrices of a model are cut alike
            d = len(coordinates(self.points))
            object.__setattr__(self, "kernel_threshold", taper_threshold(self.density, self.get_size(), d, self.scale, self.kernel))
        if not self.sparse and self.kernel_threshold is not None:
            object.__setattr__(self, "sparse", True)

    def get_size(self) -> int:
        return self.points.count()

    def get_scale(self) -> list[float]:
        return scales(self.scale, len(coordinates(self.points)))

    def get_sigmas(self, sigma=None, sigma0=None) -> tuple[float, float]:
        a, b = self.sigma if sigma is None else sigma, self.sigma0 if sigma0 is None else sigma0
        if a is None or b is None:
            raise ValueError("sigma and sigma0 are not set")
        return float(a), float(b)

    def get_options(self) -> dict:
        return dict(self.options)

    def with_options(self, **options) -> Covariance:
        return replace(self, options=self.options | options)

    def with_sigmas(self, sigma: float, sigma0: float) -> Covariance:
        return replace(self, sigma=sigma, sigma0=sigma0)

    def with_scale(self, scale) -> Covariance:
        return replace(self, scale=scale)

    def located(self) -> Covariance:
        """The covariance of this one's locations: all eigenvalues of K but the zeros of surplus copies (`pairs.located`)."""
        return replace(self, points=located(self.points))

    def _located(self, eta: float, derivative) -> tuple[Covariance, int]:
        """This or its locations', and the number of surplus copies; their share of M = K + eta I is eta times the identity."""
        if derivative or not eta or WEIGHT in self.points.columns:
            return self, 0
        own = self.located()
        surplus = self.get_size() - own.get_size()
        return (own, surplus) if surplus else (self, 0)

    def correlation(self, order: int = 0, scale=None) -> DataFrame:
        return correlation(self.points, self.scale if scale is None else scale, self.kernel, order=order, threshold=self.kernel_threshold)

    def _entries(self, derivative, scale=None) -> DataFrame:
        """(i, j, v) of K or one of its derivatives."""
        if len(derivative) > 2:
            raise NotImplementedError("derivatives of order 0, 1 and 2 exist")
        name = {0: "v", 1: "d{}", 2: "h{}{}"}[len(derivative)].format(*sorted(derivative))
        return self.correlation(len(derivative), scale).select("i", "j", F.col(name).alias("v"))

    def get_matrix(self, sigma=None, sigma0=None, scale=None, derivative=()) -> DataFrame:
        """(i, j, v), i <= j, of S or its derivative."""
        a, b = self.get_sigmas(sigma, sigma0)
        noise = F.when(F.col("i") == F.col("j"), b * b).otherwise(0.0) if not derivative else F.lit(0.0)
        return self._entries(derivative, scale).select("i", "j", ((F.lit(a * a) * F.col("v") if a >= self.tol else F.lit(0.0)) + noise).alias("v"))

    def _power(self, derivative, p) -> None:
        if derivative and p > 1:
            raise NotImplementedError("powers of derivatives don't exist")

    def _eta(self, a: float, b: float, derivative) -> float:
        return 0.0 if derivative else (b / a) ** 2

    def _dense(self, derivative, scale) -> Callable[[pd.DataFrame], np.ndarray]:
        names, s = coordinates(self.points), scales(self.scale if scale is None else scale, len(coordinates(self.points)))
        kernel, threshold = self.kernel, self.kernel_threshold

        def build(rows: pd.DataFrame) -> np.ndarray:
            x = rows[names].to_numpy(float)
            found = matrix_derivatives(kernel, x, s, len(derivative))
            if WEIGHT in rows:
                w = rows[WEIGHT].to_numpy(float)
                return (found[()] if threshold is None else np.where(found[()] >= threshold, found[()], 0.0)) * w[:, None] * w
            return found[tuple(derivative)] if threshold is None else np.where(found[()] >= threshold, found[tuple(derivative)], 0.0)

        return build

    def strips(self, eta: float, scale=None, height: int | None = None) -> tuple[strips.Strips, np.ndarray]:
        """K + eta I in strips of rows, and the i of its rows, ascending."""
        names, spark = coordinates(self.points), self.points.sparkSession
        s, kernel, threshold = scales(self.scale if scale is None else scale, len(names)), self.kernel, self.kernel_threshold
        rows = self.points.select("i", *[c for c in self.points.columns if c == WEIGHT or c in names]).toPandas().sort_values("i", kind="stable")
        held = spark.sparkContext.broadcast((rows[names].to_numpy(float), rows[WEIGHT].to_numpy(float) if WEIGHT in rows else None))

        def build(at: slice) -> np.ndarray:
            x, w = held.value
            v = matrix(kernel, x[at], s, x, threshold)
            if w is not None:
                v *= w[at, None] * w
            v[np.arange(len(v)), at.start + np.arange(len(v))] += eta
            return v

        return strips.Strips.built(spark, len(rows), height or strips.height_of(len(rows)), build), rows["i"].to_numpy()

    def envelope(self, eta: float, scale=None) -> tuple[envelope.Envelope, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """K + eta I for elimination, the i of its rows, ascending, and v -> (K + eta I) v without stored entries."""
        names, spark = coordinates(self.points), self.points.sparkSession
        s = scales(self.scale if scale is None else scale, len(names))
        rows = self.points.select("i", *[c for c in self.points.columns if c == WEIGHT or c in names]).toPandas().sort_values("i", kind="stable")
        x, w = rows[names].to_numpy(float), rows[WEIGHT].to_numpy(float) if WEIGHT in rows else np.ones(len(rows))
        product = matrix_free.products(spark, x, w, s, self.kernel, self.kernel_threshold)
        return envelope.Envelope.of(x, w, s, self.kernel, self.kernel_threshold, eta), rows["i"].to_numpy(), lambda v: product(v) + eta * v

    def _cut(self) -> bool:
        """Whether entries far from the diagonal are zero, so that elimination keeps to an envelope."""
        return self.kernel_threshold is not None and math.isfinite(self.kernel.reach(self.kernel_threshold))

    def unstored_solve(self, eta: float, scale=None, tol: float = 1e-6, least: int = MOST_DENSE) -> Callable[[DataFrame, list[str]], DataFrame] | None:
        """(K + eta I)^-1 on rows (i, names..) without stored entries, for more than `least` points; None for fewer.

        Cut kernels are eliminated, definite or not; others take preconditioned generalised minimal residuals.
        """
        if not eta or self.get_size() <= least:
            return None
        m, ids, product = self.envelope(eta, scale)
        spark, near = self.points.sparkSession, None
        if not self._cut():
            back = np.argsort(m.order)
            near = matrix_free.by_cells(spark, m.x[back], m.w[back], [1.0] * m.x.shape[1], self.kernel, self.kernel_threshold, eta)

        def solve(vectors: DataFrame, columns: list[str]) -> DataFrame:
            y = vectors.select("i", *[F.col(c).cast("double").alias(c) for c in columns]).toPandas().set_index("i").reindex(ids)[columns].to_numpy(float)
            u = envelope.solve(spark, m, y, product, tol) if near is None else matrix_free.solve(product, near, y, tol)
            return checkpointed(spark.createDataFrame(pd.DataFrame({"i": ids, **{c: u[:, k] for k, c in enumerate(columns)}}), "i long, " + ", ".join(f"{c} double" for c in columns)))

        return solve

    def inverse_traces(self, eta: float, count: int = 10, seed: int = 0, diagonal: DataFrame | None = None, scale=None) -> tuple[float, float, float]:
        """tr M^-1 of M = K + eta I, or tr K M^-1 C M^-1 with the diagonal C of rows (i, j, v); with Hutchinson's estimate and its standard error.  One elimination gives both."""
        m, ids, product = self.envelope(eta, scale)
        s = probes(self.points, count, seed).toPandas().set_index("i").loc[ids].to_numpy(float)
        tried, one = np.random.RandomState(seed).standard_normal((len(ids), 1)), np.ones(len(ids))
        both = product(np.c_[s, tried])
        ks, moved = both[:, :count] - eta * s, both[:, count:]
        if diagonal is None:
            added, border = (one,), np.c_[s, moved]
        else:
            c = diagonal.groupBy("i").agg(F.sum("v").alias("v")).toPandas().set_index("i")["v"].reindex(ids).fillna(0.0).to_numpy(float)
            added, border = (c, one), np.c_[s, ks, moved]
        _, logs, corner = envelope.eliminated(self.points.sparkSession, m, added, border)
        for known, found in ((float((tried * moved).sum()), -corner[0][-1, -1]), (float((tried * tried).sum()), corner[len(added)][-1, -1])):
            if not abs(found - known) <= 1e-6 * abs(known):
                raise ArithmeticError(f"the matrix is close to singular: a known form is {known:.9g} and comes out as {found:.9g}")
        k = np.arange(count)
        got = -corner[0][k, k] if diagonal is None else corner[1][count + k, k]
        exact = float(logs[1] if diagonal is None else logs[1] + eta * logs[3])  # tr C M^-1 - eta tr M^-1 C M^-1
        return exact, float(got.mean()), float(got.std(ddof=1) / math.sqrt(count)) if count > 1 else math.inf

    def slq_unstored(self, eta: float, count: int, degree: int, seed: int = 0) -> tuple[float, float]:
        """The estimate of log det (K + eta I) without stored entries, and its standard error."""
        _, ids, product = self.envelope(eta)
        return slq_unstored(product, probes(self.points, count, seed).toPandas().set_index("i").loc[ids].to_numpy(float), degree)

    def packs(self) -> bool:
        """Whether the cut matrix has few enough entries for one task, or no envelope to eliminate in."""
        n = self.get_size()
        if not self._cut() or n * (n + 1) // 2 <= solvers.MOST_ENTRIES:
            return True
        both = pair_count(self.points.drop(WEIGHT), self.scale, self.kernel, self.kernel_threshold).first()[0]
        return (both + n) // 2 <= solvers.MOST_ENTRIES

    def eigenvalues(self, scale=None, derivative=()) -> DataFrame:
        """(k, value) of K in ascending order."""
        build = self._dense(derivative, scale)
        return local(self.points, lambda rows: pd.DataFrame({"k": np.arange(len(rows)), "value": np.linalg.eigvalsh(build(rows))}), "k long, value double")

    def extreme_eigenvalues(self, scale=None) -> DataFrame:
        return self.eigenvalues(scale).agg(F.min("value").alias("low"), F.max("value").alias("high"))

    def trace(self, sigma=None, sigma0=None, scale=None, derivative=(), p: float = 1) -> float:
        """tr S^p.  Powers 0 to 3 are aggregates over entries; other powers come from the spectrum."""
        self._power(derivative, p)
        a, b = self.get_sigmas(sigma, sigma0)
        if p == 0:
            return 0.0 if derivative else float(self.get_size())
        if a < self.tol:
            return 0.0 if derivative else b ** (2 * p) * self.get_size()
        s = self.get_matrix(a, b, scale, derivative)
        twice = F.when(F.col("i") < F.col("j"), 2.0).otherwise(1.0)
        if p == 1:
            return float(s.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0])
        if p == 2:
            return float(s.agg(F.coalesce(F.sum(twice * F.col("v") * F.col("v")), F.lit(0.0))).first()[0])
        if p == 3:
            full = mirrored(s)
            square = full.alias("a").join(full.withColumnsRenamed({"i": "k", "j": "l", "v": "w"}), F.col("j") == F.col("k")).where("i <= l").groupBy("i", "l").agg(F.sum(F.col("v") * F.col("w")).alias("q"))
            joined = s.join(square.withColumnRenamed("l", "j"), ["i", "j"])
            return float(joined.agg(F.sum(twice * F.col("v") * F.col("q"))).first()[0])
        values = self.eigenvalues(scale, derivative)
        shift = self._eta(a, b, derivative)
        return float(values.agg(F.sum(F.pow(F.col("value") + shift, F.lit(float(p))))).first()[0]) * a ** (2 * p)

    def traceinv(self, sigma=None, sigma0=None, scale=None, derivative=(), p: int = 1, B: DataFrame | None = None, C: DataFrame | None = None) -> float:
        """tr S^-p, tr B S^-p, or tr B S^-p C S^-p; B and C are rows (i, j, v) of whole matrices.

        The methods "hutchinson" and "slq" estimate natural powers at any size; with B or C both use Hutchinson's estimator.
        """
        self._power(derivative, p)
        if C is not None and B is None:
            raise ValueError("C needs B")
        a, b = self.get_sigmas(sigma, sigma0)
        if p == 0:
            if derivative:
                return math.nan
            if B is None:
                return float(self.get_size())
            if C is None:
                return float(B.where("i = j").agg(F.sum("v")).first()[0])
            return float(B.join(C.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w")), ["i", "j"]).agg(F.sum(F.col("v") * F.col("w"))).first()[0])
        if a < self.tol:
            return math.nan if derivative else self.traceinv(1.0, 0.0, scale, (), 0, B, C) * b ** (-2 * p * (2 if C is not None else 1))
        eta, method = self._eta(a, b, derivative), self.options.get("method", "cholesky")
        if method == "cholesky" and derivative:
            raise ValueError("derivatives of a covariance aren't positive definite; use the eigenvalue method")
        if B is None:
            own, surplus = self._located(eta, derivative)
            if surplus:
                return own.traceinv(a, b, scale, (), p) + surplus * eta ** float(-p) * a ** (-2 * p)
        if method in ("hutchinson", "slq") and not derivative and float(p).is_integer() and p > 0:
            count, upper = self.options.get("max_num_samples", 20), self.correlation(0, scale)
            if method == "slq" and B is None:
                return slq_logdet(upper, self.points, eta, count, self.options.get("lanczos_degree", 20), function=lambda x: x ** -float(p))[0] * a ** (-2 * p)
            return hutchinson_traceinv(upper, self.points, eta, count, tol=self.options.get("solver_tol", 1e-6), p=int(p), B=B, C=C, solve=self.unstored_solve(eta, scale, self.options.get("solver_tol", 1e-6)))[0] * a ** (-2 * p * (2 if C is not None else 1))
        whole = not derivative and float(p).is_integer() and p > 0
        if whole and (B is not None or self.get_size() > MOST_DENSE):
            return self._traceinv_by_strips(eta, scale, int(p), B, C) * a ** (-2 * p * (2 if C is not None else 1))
        build = self._dense(derivative, scale)
        if B is None:

            def spectral(rows: pd.DataFrame) -> pd.DataFrame:
                lam = np.linalg.eigvalsh(build(rows) + eta * np.eye(len(rows)))
                return pd.DataFrame({"value": [float((lam ** float(-p)).sum())]})

            return float(local(self.points, spectral, "value double").first()[0]) * a ** (-2 * p)

        def inverse(rows: pd.DataFrame) -> pd.DataFrame:
            lam, u = np.linalg.eigh(build(rows) + eta * np.eye(len(rows)))
            i = rows["i"].to_numpy()
            return pd.DataFrame({"i": np.repeat(i, len(i)), "j": np.tile(i, len(i)), "v": ((u * lam ** float(-p)) @ u.T).ravel()})

        power = checkpointed(local(self.points, inverse, "i long, j long, v double"))

        def times(left: DataFrame, right: DataFrame) -> DataFrame:
            """The entries of a product, by a join on the inner index; repeated entries of one place add up."""
            both = left.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(right.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
            return both.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))

        right = power if C is None else times(C, power)
        left = B if C is None else times(B, power)
        total = left.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(right.select(F.col("i").alias("k"), F.col("j").alias("i"), F.col("v").alias("y")), ["i", "k"])
        value = total.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0.0
        return float(value) * a ** (-2 * p * (2 if C is not None else 1))

    def _traceinv_by_strips(self, eta: float, scale, p: int, B: DataFrame | None, C: DataFrame | None) -> float:
        """tr M^-p, tr B M^-p or tr B M^-p C M^-p of M = K + eta I, for any number of points."""
        held, ids = self.strips(eta, scale)
        strips.inverted(held)
        power = held
        for _ in range(p - 1 if B is not None else p - 2):
            power = strips.multiplied(power, held)
        of = lambda rows: strips.Strips.of_entries(rows, ids, held.height)
        turned = lambda rows: of(rows.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
        if B is None:
            value = strips.inner(power, held) if p > 1 else held.total(lambda row, a: np.trace(a[:, row:]))
        elif C is None:
            value = strips.inner(of(B), power)
        elif C.where("i <> j").isEmpty():
            weights = C.groupBy("i").agg(F.sum("v").alias("v")).toPandas().set_index("i")["v"].reindex(ids).fillna(0.0).to_numpy(float)
            columns = turned(B)
            value = strips.weighted(power, columns, weights)
            columns.dropped()
        else:  # the inverse is symmetric: (C M^-p)' = M^-p C'
            value = strips.inner(strips.multiplied(of(B), power), strips.multiplied(power, turned(C)))
        for m in (held, power):
            m.dropped()
        return value

    def logdet(self, sigma=None, sigma0=None, scale=None, derivative=(), p: float = 1) -> float:
        self._power(derivative, p)
        a, b = self.get_sigmas(sigma, sigma0)
        if derivative and (p == 0 or a < self.tol):
            return -math.inf
        if p == 0:
            return 0.0
        n = self.get_size()
        if a < self.tol:
            return 2 * p * n * math.log(b)
        eta, method = self._eta(a, b, derivative), self.options.get("method", "cholesky")
        if method == "slq" and not derivative:
            own, surplus = self._located(eta, derivative)
            if surplus:
                return own.logdet(a, b, scale, (), p) + p * surplus * (math.log(eta) + 2 * math.log(a))
            return p * slq_logdet(self.correlation(0, scale), self.points, eta, self.options.get("max_num_samples", 20), self.options.get("lanczos_degree", 20))[0] + 2 * p * n * math.log(a)
        if method != "eigenvalue" and derivative:
            raise ValueError("derivatives of a covariance aren't positive definite; use the eigenvalue method")
        own, surplus = self._located(eta, derivative)
        if surplus:
            return own.logdet(a, b, scale, (), p) + p * surplus * (math.log(eta) + 2 * math.log(a))
        if not derivative and n > MOST_DENSE:
            if self._cut():
                negative, (log,), _ = envelope.eliminated(self.points.sparkSession, self.envelope(eta, scale)[0], definite=True)
            else:
                held, _ = self.strips(eta, scale)
                negative, log = strips.inverted(held)
                held.dropped()
            if negative:
                raise np.linalg.LinAlgError("the matrix is not positive definite")
            return p * log + 2 * p * n * math.log(a)
        build = self._dense(derivative, scale)

        def work(rows: pd.DataFrame) -> pd.DataFrame:
            m = build(rows) + eta * np.eye(len(rows))
            value = np.linalg.slogdet(m)[1] if derivative else 2 * np.log(np.diag(np.linalg.cholesky(m))).sum()
            return pd.DataFrame({"value": [float(value)]})

        return p * float(local(self.points, work, "value double").first()[0]) + 2 * p * n * math.log(a)

    def solve(self, vectors: DataFrame, names: list[str], sigma=None, sigma0=None, scale=None, derivative=(), p: int = 1) -> DataFrame:
        """(i, names..) of S^-p y for the columns of rows (i, names..): Cholesky if dense; if sparse by options["solver"]: cg, minres
        or gmres on packed entries in one task (more entries than it holds are eliminated), or dataframe-cg for any number of them, of more than `MOST_DENSE` locations by products without stored entries."""
        self._power(derivative, p)
        a, b = self.get_sigmas(sigma, sigma0)
        if p == 0 and not derivative:
            return vectors.select("i", *names)
        if a < self.tol or p == 0:
            factor = math.nan if p == 0 else 0.0 if derivative else b ** (-2 * p)
            return vectors.select("i", *[(F.col(c) * F.lit(factor)).alias(c) for c in names])
        eta = self._eta(a, b, derivative)
        own, surplus = self._located(eta, derivative)
        if surplus:
            out = vectors.select("i", *names)
            for _ in range(p):
                out = self._solve_by_location(own, out, names, a, b, scale)
            return out
        if self.sparse and not derivative:
            out, upper = vectors.select("i", *names), self.correlation(0, scale)
            solver, tol = self.options.get("solver", "cg"), self.options.get("solver_tol", 1e-6)
            if solver == "dataframe-cg" or not replace(self, scale=self.scale if scale is None else scale).packs():
                unstored = self.unstored_solve(eta, scale, tol, MOST_DENSE if solver == "dataframe-cg" else 0)
                for _ in range(p):
                    out = unstored(out, names) if unstored else conjugate_gradient(upper, out, names, eta, tol)
            else:

                def packed(m: Packed, ids: np.ndarray, y: np.ndarray) -> pd.DataFrame:
                    for _ in range(p):
                        y = solvers.solve_symmetric(m, eta, y, solver, tol)
                    return pd.DataFrame({"i": ids, **{c: y[:, k] for k, c in enumerate(names)}})

                out = solvers.packed_task(upper, out, names, packed, "i long, " + ", ".join(f"{c} double" for c in names))
        else:
            build = self._dense(derivative, scale)

            def work(rows: pd.DataFrame) -> pd.DataFrame:
                m, y = build(rows) + eta * np.eye(len(rows)), rows[names].to_numpy(float)
                for _ in range(p):
                    y = np.linalg.solve(m, y)
                return pd.DataFrame({"i": rows["i"], **{c: y[:, k] for k, c in enumerate(names)}})

            own = [c for c in self.points.columns if c not in names]
            out = local(self.points.select(*own).join(vectors.select("i", *names), "i"), work, "i long, " + ", ".join(f"{c} double" for c in names))
        return out.select("i", *[(F.col(c) * a ** (-2 * p)).alias(c) for c in names])

    def _solve_by_location(self, own: Covariance, vectors: DataFrame, names: list[str], a: float, b: float, scale) -> DataFrame:
        """S^-1 y: of what a location's copies share by the locations' covariance, and the rest over sigma0^2."""
        place, eta = coordinates(self.points), (b / a) ** 2
        same = lambda left, right: [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in place]
        at = self.points.select("i", *place).alias("p").join(own.points.alias("l"), same("p", "l")).select(F.col("p.i").alias("i"), F.col("l.i").alias("at"), F.col(f"l.{WEIGHT}").alias("w"))
        rows = checkpointed(at.join(vectors.select("i", *names), "i"))
        means = checkpointed(rows.groupBy("at").agg(F.first("w").alias("w"), *[F.avg(c).alias(f"m_{c}") for c in names]))
        right = own.points.select("i", *place, WEIGHT).join(means.select(F.col("at").alias("i"), *[(F.col(f"m_{c}") * F.col("w")).alias(c) for c in names]), "i")
        solved = own.solve(right, names, a, b, scale).select(F.col("i").alias("at"), *[F.col(c).alias(f"s_{c}") for c in names])
        both = rows.join(means.drop("w"), "at").join(solved, "at")
        return both.select("i", *[((F.col(c) - F.col(f"m_{c}")) / F.lit(eta * a * a) + F.col(f"s_{c}") / F.col("w")).alias(c) for c in names])

    def dot(self, vectors: DataFrame, names: list[str], sigma=None, sigma0=None, scale=None, derivative=(), p: int = 1) -> DataFrame:
        """(i, names..) of S^p x by joins on the matrix entries."""
        if isinstance(p, bool) or int(p) != p or p < 0:
            raise ValueError("p is a natural number")
        self._power(derivative, p)
        a, b = self.get_sigmas(sigma, sigma0)
        out = vectors.select("i", *[F.col(c).cast("double").alias(c) for c in names])
        if derivative and (p == 0 or a < self.tol):
            return out.select("i", *[(F.col(c) * 0.0).alias(c) for c in names])
        if a < self.tol:
            return out.select("i", *[(F.col(c) * b ** (2 * p)).alias(c) for c in names])
        entries = self._entries(derivative, scale)
        for _ in range(int(p)):
            out = shifted_product(entries, out, names, self._eta(a, b, derivative)).select("i", *[(F.col(c) * a * a).alias(c) for c in names])
        return out

    def auto_covariance(self, tests: DataFrame) -> DataFrame:
        """(i, j, v), i <= j, among test points, without noise."""
        a = self.get_sigmas(None, 0.0)[0]
        return correlation(tests, self.scale, self.kernel, threshold=self.kernel_threshold).withColumn("v", F.col("v") * a * a)

    def cross_covariance(self, tests: DataFrame) -> DataFrame:
        """(i, t, v) between points and test points."""
        a = self.get_sigmas(None, 0.0)[0]
        return correlation(self.points, self.scale, self.kernel, threshold=self.kernel_threshold, tests=tests).withColumn("v", F.col("v") * a * a)
