"""Special functions that neither Spark nor numpy has."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_T = np.linspace(0.0, 12.0, 4001)
_W = np.full(_T.size, _T[1])
_W[[0, -1]] /= 2


def bessel_k(nu: float, y: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Modified Bessel function of the second kind, K_nu(y) for y > 0, from its cosh integral by the trapezoid rule."""
    y = np.asarray(y, float).ravel()
    out = np.empty(y.size)
    grow = np.cosh(nu * _T) * _W
    for s in range(0, y.size, rows):
        out[s : s + rows] = np.exp(-np.outer(y[s : s + rows], np.cosh(_T))) @ grow
    return out


def ball_volume(radius: float, dimension: int) -> float:
    return math.pi ** (dimension / 2) / math.gamma(1 + dimension / 2) * radius**dimension


def ball_radius(volume: float, dimension: int) -> float:
    return (volume * math.gamma(1 + dimension / 2) / math.pi ** (dimension / 2)) ** (1 / dimension)


def normal_quantile(confidence: float) -> float:
    """Half width, in standard deviations, of the central interval with this probability."""
    if not 0 < confidence < 1:
        raise ValueError("the confidence level lies between 0 and 1")
    return NormalDist().inv_cdf((1 + confidence) / 2)
