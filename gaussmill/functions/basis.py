"""Basis functions of the mean: design matrix columns b0, b1, ... of the coordinates x0, x1, ..."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monomials(dimension: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of total degree up to `degree`.

    The last coordinate of three or more varies fastest, then the first, and the
    second slowest; of two the second varies fastest inside each power of the
    first... in other words the order of a grid whose first two axes are
    exchanged: for two coordinates and degree 2 it is 1, x0, x0^2, x1, x0 x1, x1^2.
    """
    axes = list(range(dimension))
    if dimension > 1:
        axes[0], axes[1] = axes[1], axes[0]
    out = []
    for powers in product(range(degree + 1), repeat=dimension):
        exponent = [0] * dimension
        for axis, p in zip(axes, powers, strict=True):
            exponent[axis] = p
        if sum(exponent) <= degree:
            out.append(tuple(exponent))
    return out


@dataclass(frozen=True)
class Basis:
    """Polynomial, trigonometric, hyperbolic and custom functions, in this order.

    `func` takes the list of coordinate columns and returns a list of columns.
    """

    polynomial_degree: int | None = 0
    trigonometric_coeff: tuple[float, ...] = ()
    hyperbolic_coeff: tuple[float, ...] = ()
    func: Callable[[list[Column]], list[Column]] | None = field(default=None, compare=False)

    def __post_init__(self):
        for name in ("trigonometric_coeff", "hyperbolic_coeff"):
            value = getattr(self, name)
            values = () if value is None else tuple(np.atleast_1d(np.asarray(value, float)).tolist())
            object.__setattr__(self, name, values)
        degree = self.polynomial_degree
        if degree is not None and (isinstance(degree, bool) or not isinstance(degree, int) or degree < 0):
            raise ValueError("the polynomial degree is a natural number or None")
        if degree is None and not self.trigonometric_coeff and not self.hyperbolic_coeff and self.func is None:
            raise ValueError("at least one basis function is needed")
        if self.func is not None and not callable(self.func):
            raise TypeError("func must be callable")

    def columns(self, x: list[Column]) -> list[Column]:
        out = []
        if self.polynomial_degree is not None:
            for exponents in monomials(len(x), self.polynomial_degree):
                term = F.lit(1.0)
                for c, p in zip(x, exponents, strict=True):
                    for _ in range(p):
                        term = term * c
                out.append(term)
        for coefficients, pair in ((self.trigonometric_coeff, (F.sin, F.cos)), (self.hyperbolic_coeff, (F.sinh, F.cosh))):
            out += [f(c * a) for a in coefficients for c in x for f in pair]
        if self.func is not None:
            out += self.func(x)
        return [c.cast("double").alias(f"b{k}") for k, c in enumerate(out)]


def coordinates(df: DataFrame) -> list[str]:
    """x0, x1, ... in order."""
    found = [c for c in df.columns if c[:1] == "x" and c[1:].isdigit()]
    return sorted(found, key=lambda c: int(c[1:]))


def design_matrix(points: DataFrame, basis: Basis) -> DataFrame:
    """The points with the basis columns beside them."""
    return points.select("*", *basis.columns([F.col(c) for c in coordinates(points)]))


def gram(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Sums of products of columns: one aggregate, len(left) x len(right) numbers."""
    row = df.agg(*[F.sum(F.col(a) * F.col(b)) for a in left for b in right]).first()
    return np.array([v if v is not None else 0.0 for v in row], float).reshape(len(left), len(right))


def orthonormalizer(df: DataFrame) -> np.ndarray:
    """R with B R orthonormal, B the basis columns: the inverse of the Gram matrix's Cholesky factor."""
    names = [c for c in df.columns if c[:1] == "b" and c[1:].isdigit()]
    return np.linalg.inv(np.linalg.cholesky(gram(df, names, names))).T


def apply_right(df: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Replace the basis columns B by B times the matrix."""
    names = [c for c in df.columns if c[:1] == "b" and c[1:].isdigit()]
    mixed = [sum((F.col(b) * F.lit(float(matrix[r, k])) for r, b in enumerate(names)), F.lit(0.0)).alias(f"b{k}") for k in range(matrix.shape[1])]
    return df.select(*[c for c in df.columns if c not in names], *mixed)


def orthonormalized(df: DataFrame) -> DataFrame:
    return apply_right(df, orthonormalizer(df))
