"""Prior densities of the scale, with derivatives, on columns or arrays.

Each prior gives its density p and the derivatives g, h of log p, so that
p' = p g and p'' = p (g^2 + h).  Parameters are scalars or one per dimension.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaussmill.functions.backend import Arrays, backend_of

LN10 = math.log(10.0)


def _numbers(value, what: str, positive: bool = False):
    values = np.atleast_1d(np.asarray(value, float))
    if values.ndim != 1 or np.isnan(values).any():
        raise ValueError(f"{what} must be a number or a list of numbers")
    if positive and (values <= 0).any():
        raise ValueError(f"{what} must be positive")
    return value


class Prior:
    half = False
    #: Names of the parameters, in the order of the constructor.
    names: tuple[str, ...] = ()

    def _at(self, k: int, count: int) -> tuple[float, ...]:
        """The parameters of dimension k of `count`."""
        out = []
        for name in self.names:
            values = np.atleast_1d(np.asarray(getattr(self, name), float))
            if values.size not in (1, count):
                raise ValueError(f"{name} has {values.size} values for {count} dimensions")
            out.append(float(values[k] if values.size > 1 else values[0]))
        return tuple(out)

    def _parts(self, m, x, *parameters):
        """p, g, h at x > 0 or in general, whatever the support is."""
        raise NotImplementedError

    def _zero(self, order: int, *parameters) -> float | None:
        """The density's derivative of this order at 0, if the general form isn't valid there."""
        return None

    def density(self, x, derivative: int = 0, dimension: int = 0, count: int = 1):
        """p, p' or p'' of one dimension."""
        m, own = backend_of(x), self._at(dimension, count)
        x = np.asarray(x, float) if m is Arrays else x
        with np.errstate(all="ignore"):
            p, g, h = self._parts(m, x, *own)
            out = (p, p * g, p * (g * g + h))[derivative]
            zero = self._zero(derivative, *own)
            out = out if zero is None else m.where(x == 0.0, m.const(zero, x), m.where(x < 0.0, m.const(0.0, x), out))
        return out * 2.0 if self.half else out

    def pdf(self, x) -> np.ndarray:
        x = np.atleast_1d(np.asarray(x, float))
        return np.array([float(self.density(np.array(v), 0, k, x.size)) for k, v in enumerate(x)])

    def pdf_jacobian(self, x) -> np.ndarray:
        x = np.atleast_1d(np.asarray(x, float))
        return np.array([float(self.density(np.array(v), 1, k, x.size)) for k, v in enumerate(x)])

    def pdf_hessian(self, x) -> np.ndarray:
        x = np.atleast_1d(np.asarray(x, float))
        return np.diag([float(self.density(np.array(v), 2, k, x.size)) for k, v in enumerate(x)])

    def log_pdf(self, hyperparam, use_log_scale: bool = True) -> float:
        x = np.power(10.0, np.atleast_1d(hyperparam)) if use_log_scale else np.atleast_1d(np.asarray(hyperparam, float))
        p = self.pdf(x)
        return -math.inf if (p == 0).any() else float(np.log(p).sum())

    def log_pdf_jacobian(self, hyperparam, use_log_scale: bool = True) -> np.ndarray:
        x = np.power(10.0, np.atleast_1d(hyperparam)) if use_log_scale else np.atleast_1d(np.asarray(hyperparam, float))
        with np.errstate(all="ignore"):
            out = self.pdf_jacobian(x) / self.pdf(x)
        return out * x * LN10 if use_log_scale else out

    def log_pdf_hessian(self, hyperparam, use_log_scale: bool = True) -> np.ndarray:
        x = np.power(10.0, np.atleast_1d(hyperparam)) if use_log_scale else np.atleast_1d(np.asarray(hyperparam, float))
        with np.errstate(all="ignore"):
            slope = self.pdf_jacobian(x) / self.pdf(x)
            out = np.diag(self.pdf_hessian(x)) / self.pdf(x) - slope**2
        return np.diag(out * x**2 * LN10**2 + slope * x * LN10**2 if use_log_scale else out)

    def columns(self, x) -> list:
        """pdf, d1, d2, log_pdf, and the log density's derivatives by log10 of x, as columns."""
        p, d1, d2 = (self.density(x, k) for k in range(3))
        slope = d1 / p
        some = p > 0.0
        return [
            p.alias("pdf"), d1.alias("d1"), d2.alias("d2"),
            F.when(some, F.log(p)).otherwise(F.lit(-math.inf)).alias("log_pdf"),
            F.when(some, slope * x * LN10).alias("log_d1"),
            F.when(some, (d2 / p - slope * slope) * x * x * LN10**2 + slope * x * LN10**2).alias("log_d2"),
        ]

    def suggest_hyperparam(self, positive: bool = False):
        sizes = max(np.atleast_1d(np.asarray(getattr(self, n), float)).size for n in self.names)
        out = [float(self._suggest(positive, *self._at(k, sizes))) for k in range(sizes)]
        return out[0] if sizes == 1 else out

    def table(self, spark: SparkSession, low: float, high: float, points: int = 200) -> DataFrame:
        """x, density, derivatives, and central differences: the data of a plot."""
        step = (high - low) / (points - 1)
        t = spark.range(points).withColumn("x", F.lit(float(low)) + F.col("id") * F.lit(step))
        t = t.withColumns({f"d{k}": self.density(F.col("x"), k) for k in range(3)})
        w = W.orderBy("id")
        up, down = F.lead("d0").over(w), F.lag("d0").over(w)
        return t.withColumns({"n1": (up - down) / (2 * step), "n2": (up - 2 * F.col("d0") + down) / step**2}).drop("id")


@dataclass(frozen=True)
class Uniform(Prior):
    a: float = 0.0
    b: float = math.inf
    names = ("a", "b")

    def __post_init__(self):
        if (np.asarray(_numbers(self.a, "a"), float) >= np.asarray(_numbers(self.b, "b"), float)).any():
            raise ValueError("a must be less than b")

    def _parts(self, m, x, a, b):
        inside = 1.0 / (b - a) if math.isfinite(a) and math.isfinite(b) else 1.0
        zero = m.const(0.0, x)
        return m.where((x >= a) & (x <= b), m.const(inside, x), zero), zero, zero

    def mean(self, k: int = 0, count: int = 1) -> float:
        a, b = self._at(k, count)
        return (a + b) / 2

    def _suggest(self, positive, a, b):
        if math.isfinite(a) and math.isfinite(b):
            middle = (a + b) / 2
            return middle if middle > 0 or not positive else b / 2
        if math.isfinite(b):
            return b / 2
        return 2 * a if math.isfinite(a) and a > 0 else 1.0


@dataclass(frozen=True)
class Normal(Prior):
    mean: float = 0.0
    std: float = 1.0
    half: bool = False
    names = ("mean", "std")

    def __post_init__(self):
        _numbers(self.mean, "mean"), _numbers(self.std, "std", True)

    def _parts(self, m, x, mean, std):
        u = (x - mean) / std
        return m.exp(-0.5 * u * u) / (std * math.sqrt(2 * math.pi)), -u / std, m.const(-1 / std**2, x)

    def _suggest(self, positive, mean, std):
        return std if self.half or (positive and mean <= 0) else mean


@dataclass(frozen=True)
class Cauchy(Prior):
    median: float = 0.0
    scale: float = 1.0
    half: bool = False
    names = ("median", "scale")

    def __post_init__(self):
        _numbers(self.median, "median"), _numbers(self.scale, "scale", True)

    def _parts(self, m, x, median, scale):
        u = (x - median) / scale
        v = 1.0 + u * u
        return 1.0 / (v * (math.pi * scale)), -2.0 * u / (v * scale), -2.0 * (1.0 - u * u) / (v * v * scale**2)

    def _suggest(self, positive, median, scale):
        return scale if self.half or (positive and median <= 0) else median


@dataclass(frozen=True)
class StudentT(Prior):
    dof: float = 1.0
    half: bool = False
    names = ("dof",)

    def __post_init__(self):
        _numbers(self.dof, "dof", True)

    def _parts(self, m, x, nu):
        c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
        v = x * x + nu
        return c * m.power(v / nu, -(nu + 1) / 2), -(nu + 1) * x / v, -(nu + 1) * (nu - x * x) / (v * v)

    def _suggest(self, positive, nu):
        return math.sqrt(nu / (nu - 2)) * (math.sqrt(2) if self.half else 1.0) if nu > 2 else 1.0


def _power_at_zero(c: float, e: float, series, order: int) -> float:
    """The derivative at 0 of c x^e (s0 + s1 x + s2 x^2 + ...), where series(k) is s_k."""
    if e == int(e):
        k = order - int(e)
        return c * series(k) * math.factorial(order) if k >= 0 else 0.0
    if e > order:
        return 0.0
    lead = math.prod(e - i for i in range(order))
    return math.copysign(math.inf, c * lead)


@dataclass(frozen=True)
class Gamma(Prior):
    shape: float = 1.0
    rate: float = 1.0
    names = ("shape", "rate")

    def __post_init__(self):
        _numbers(self.shape, "shape", True), _numbers(self.rate, "rate", True)

    def _parts(self, m, x, a, b):
        c = math.exp(a * math.log(b) - math.lgamma(a))
        return c * m.power(x, a - 1) * m.exp(-b * x), (a - 1) / x - b, (1 - a) / (x * x)

    def _zero(self, order, a, b):
        return _power_at_zero(math.exp(a * math.log(b) - math.lgamma(a)), a - 1, lambda k: (-b) ** k / math.factorial(k), order)

    def _suggest(self, positive, a, b):
        return a / b


@dataclass(frozen=True)
class Erlang(Gamma):
    """Gamma with an integer shape."""

    def __post_init__(self):
        super().__post_init__()
        if any(float(v) != int(v) for v in np.atleast_1d(self.shape)) or isinstance(self.shape, float):
            raise ValueError("shape must be an integer")


@dataclass(frozen=True)
class InverseGamma(Prior):
    shape: float = 1.0
    scale: float = 1.0
    names = ("shape", "scale")

    def __post_init__(self):
        _numbers(self.shape, "shape", True), _numbers(self.scale, "scale", True)

    def _parts(self, m, x, a, b):
        c = math.exp(a * math.log(b) - math.lgamma(a))
        return c * m.power(x, -a - 1) * m.exp(-b / x), -(a + 1) / x + b / (x * x), (a + 1) / (x * x) - 2 * b / (x * x * x)

    def _zero(self, order, a, b):
        return math.inf  # by convention; a scale of zero is no scale

    def _suggest(self, positive, a, b):
        return b / (a - 1) if a > 1 else b / (a + 1)


@dataclass(frozen=True)
class BetaPrime(Prior):
    alpha: float = 1.0
    beta: float = 1.0
    names = ("alpha", "beta")

    def __post_init__(self):
        _numbers(self.alpha, "alpha", True), _numbers(self.beta, "beta", True)

    def _parts(self, m, x, a, b):
        c = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        u = 1.0 + x
        return c * m.power(x, a - 1) * m.power(u, -a - b), (a - 1) / x - (a + b) / u, (1 - a) / (x * x) + (a + b) / (u * u)

    def _zero(self, order, a, b):
        c = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        return _power_at_zero(c, a - 1, lambda k: math.prod(-(a + b) - i for i in range(k)) / math.factorial(k), order)

    def _suggest(self, positive, a, b):
        return a / (b - 1) if b > 1 else (a - 1) / (b + 1) if a > 1 else 1.0
