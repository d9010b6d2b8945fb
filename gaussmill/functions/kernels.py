"""Correlation kernels of a scaled distance, with two derivatives.

``kernel(x)``, ``kernel(x, 1)`` and ``kernel(x, 2)`` take a column and return a
column, or take a numpy array and return an array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from gaussmill.functions.backend import Arrays, backend_of
from gaussmill.functions.special import bessel_k
from gaussmill.runtime import ship_package

NEAR, SMOOTH = 1e-8, 100.0


class Kernel:
    """Base class: a kernel defines value(m, x), first(m, x) and second(m, x) against a backend m."""

    def value(self, m, x):
        raise NotImplementedError

    def first(self, m, x):
        raise NotImplementedError

    def second(self, m, x):
        raise NotImplementedError

    def get_parameters(self) -> list[float]:
        return []

    def reach(self, threshold: float) -> float:
        """The distance up to which the kernel is at least the threshold; inf if it always is."""
        if threshold <= 0:
            return math.inf
        low, high = 0.0, 1.0
        at = lambda r: float(self(np.array([r]))[0])
        if threshold > 1:
            return 0.0
        while at(high) >= threshold:
            high *= 2
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if at(middle) >= threshold else (low, middle)
        return high

    def __call__(self, x, derivative: int = 0):
        if derivative not in (0, 1, 2):
            raise NotImplementedError("derivatives 0, 1 and 2 exist")
        m = backend_of(x)
        x = np.asarray(x, float) if m is Arrays else x
        return (self.value, self.first, self.second)[derivative](m, x)

    def table(self, spark: SparkSession, x_max: float = 4.0, points: int = 200) -> DataFrame:
        """x, the kernel and its derivatives, and central differences of the kernel: the data of a plot."""
        step = x_max / (points - 1)
        t = spark.range(points).withColumn("x", F.col("id") * F.lit(step))
        t = t.withColumns({f"d{k}": self(F.col("x"), k) for k in range(3)})
        w = W.orderBy("id")  # a plot's fixed number of points
        up, down = F.lead("d0").over(w), F.lag("d0").over(w)
        return t.withColumns({"n1": (up - down) / (2 * step), "n2": (up - 2 * F.col("d0") + down) / step**2}).drop("id")


@dataclass(frozen=True)
class Exponential(Kernel):
    def value(self, m, x):
        return m.exp(-x)

    def first(self, m, x):
        return -m.exp(-x)

    def second(self, m, x):
        return m.exp(-x)


@dataclass(frozen=True)
class SquareExponential(Kernel):
    def value(self, m, x):
        return m.exp(-0.5 * x * x)

    def first(self, m, x):
        return -x * m.exp(-0.5 * x * x)

    def second(self, m, x):
        return (x * x - 1.0) * m.exp(-0.5 * x * x)


@dataclass(frozen=True)
class Linear(Kernel):
    def value(self, m, x):
        return m.where(m.absolute(x) <= 1.0, 1.0 - x, m.const(0.0, x))

    def first(self, m, x):
        return m.where(m.absolute(x) <= 1.0, m.const(-1.0, x), m.const(0.0, x))

    def second(self, m, x):
        return m.const(0.0, x)


def _number(value, what: str) -> None:
    if isinstance(value, bool) or not isinstance(value, int | float) or not value > 0:
        raise ValueError(f"{what} must be a positive number")


@dataclass(frozen=True)
class RationalQuadratic(Kernel):
    alpha: float = 2.0

    def __post_init__(self):
        _number(self.alpha, "alpha")

    def get_parameters(self):
        return [self.alpha]

    def _u(self, x):
        return 1.0 + x * x / (2.0 * self.alpha)

    def value(self, m, x):
        return m.power(self._u(x), -self.alpha)

    def first(self, m, x):
        return -x * m.power(self._u(x), -self.alpha - 1)

    def second(self, m, x):
        u = self._u(x)
        return x * x * (1.0 + 1.0 / self.alpha) * m.power(u, -self.alpha - 2) - m.power(u, -self.alpha - 1)


@dataclass(frozen=True)
class Matern(Kernel):
    """Half-integer nu of 1/2, 3/2 and 5/2 in closed form; nu of 100 or more as its limit; else by Bessel functions.

    At distance 0 the second derivative of the general form is its limit
    -nu / (nu - 1) for nu > 1, as the closed forms give.
    """

    nu: float = 0.5
    general: bool = False

    def __post_init__(self):
        _number(self.nu, "nu")

    def get_parameters(self):
        return [self.nu]

    def _order(self, m, x, k: int):
        nu = self.nu
        if not self.general and nu in (0.5, 1.5, 2.5):
            s = math.sqrt(2 * nu)
            y = s * x
            e = m.exp(-y)
            if nu == 0.5:
                return (e, -e, e)[k]
            if nu == 1.5:
                return ((1.0 + y) * e, -s * y * e, s * s * (y - 1.0) * e)[k]
            return ((1.0 + y + y * y / 3.0) * e, -s * y * (1.0 + y) / 3.0 * e, s * s * (y * y - y - 1.0) / 3.0 * e)[k]
        if nu >= SMOOTH:
            return SquareExponential()(x, k)
        if m is Arrays:
            return self._bessel(np.asarray(x, float), k)
        kernel = self
        ship_package(SparkSession.getActiveSession())

        @F.pandas_udf(DoubleType())
        def bessel(v: pd.Series) -> pd.Series:
            return pd.Series(kernel._bessel(v.to_numpy(float), k))

        return bessel(x)

    def _bessel(self, x: np.ndarray, k: int) -> np.ndarray:
        nu, shape, x = self.nu, x.shape, np.abs(x).ravel()
        root = math.sqrt(2 * nu)
        y = root * np.maximum(x, NEAR)
        c = 2 ** (1 - nu) / math.gamma(nu)
        low, mid = bessel_k(abs(nu - 1), y), bessel_k(nu, y)  # K_{-a} = K_a
        if k == 0:
            out = np.where(x < NEAR, 1.0, c * y**nu * mid)
        elif k == 1:  # (y^nu K_nu)' = -y^nu K_{nu-1}
            out = -c * root * y**nu * low
            out = np.where(x < NEAR, 0.0, out) if nu >= 1 else out
        else:  # and (y^nu K_{nu-1})' = y^(nu-1) K_{nu-1} - y^nu K_{nu-2}
            out = -c * root**2 * (y ** (nu - 1) * low - y**nu * bessel_k(abs(nu - 2), y))
            out = np.where(x < NEAR, -nu / (nu - 1), out) if nu > 1 else out
        return out.reshape(shape)

    def value(self, m, x):
        return self._order(m, x, 0)

    def first(self, m, x):
        return self._order(m, x, 1)

    def second(self, m, x):
        return self._order(m, x, 2)


def kernel_columns(kernel: Kernel, x: Column) -> list[Column]:
    return [kernel(x, k).alias(f"d{k}") for k in range(3)]
