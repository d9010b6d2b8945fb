"""One spelling of a formula for two worlds: Spark columns and numpy arrays.

Kernels and priors are written once against these names.  On columns they
become Catalyst expressions inside whole-stage code; on arrays they serve dense
factorisations inside a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


class Columns:
    exp, sqrt, log, sin, cos, sinh, cosh, absolute = map(staticmethod, (F.exp, F.sqrt, F.log, F.sin, F.cos, F.sinh, F.cosh, F.abs))

    @staticmethod
    def power(x, p):
        return F.pow(x, F.lit(float(p)))

    @staticmethod
    def where(test, a, b):
        return F.when(test, a).otherwise(b)

    @staticmethod
    def const(x, like):
        return F.lit(float(x))


class Arrays:
    exp, sqrt, log, sin, cos, sinh, cosh, absolute = map(staticmethod, (np.exp, np.sqrt, np.log, np.sin, np.cos, np.sinh, np.cosh, np.abs))

    @staticmethod
    def power(x, p):
        return np.power(x, float(p))

    @staticmethod
    def where(test, a, b):
        return np.where(test, a, b)

    @staticmethod
    def const(x, like):
        return np.full(np.shape(like), float(x))


def backend_of(x):
    return Arrays if isinstance(x, np.ndarray | float | int) else Columns
