"""Solves with K + eta I of many locations, whose entries are never stored.

Tasks evaluate the kernel between their part of the locations and all others
within its reach, product by product; vectors stay in the driver.  GMRES is
preconditioned by the same kernel on cells of locations, so crowded locations
and the negative eigenvalues that cutting leaves cost few steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

from gaussmill.functions.kernels import Kernel
from gaussmill.operators.sums import _pieces
from gaussmill.runtime import ship_package

CELLS, MOST_HELD = 2000, 20_000_000


def products(spark: SparkSession, x: np.ndarray, w: np.ndarray, scale: list[float], kernel: Kernel, threshold: float | None) -> Callable[[np.ndarray], np.ndarray]:
    """V -> K V, entries weighted by w on both sides, for the columns of V.  A task takes its part of the locations and those after it, so a value serves both triangles."""
    ship_package(spark)
    x = x / np.array(scale)
    reach = kernel.reach(threshold) if threshold is not None else math.inf
    order = np.lexsort((x[:, 0], *(np.floor(x[:, k]) for k in range(1, x.shape[1]))))
    parts = min(len(x), 4 * spark.sparkContext.defaultParallelism)
    ends = np.linspace(0, len(x), parts + 1).astype(int)
    held = spark.sparkContext.broadcast((x, order, ends))
    tasks = spark.sparkContext.parallelize(range(parts), parts)

    def dot(v: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(w[:, None] * v)

        def work(part: int) -> tuple[int, bytes, bytes]:
            y, by, cut = held.value
            at = by[cut[part] :]
            many, later, right = cut[part + 1] - cut[part], y[at], sent.value[at]
            out = np.zeros(right.shape)
            for rows, others in _pieces(later[:many], later, reach):
                total = (later[rows, 0][:, None] - later[None, others, 0]) ** 2
                for k in range(1, y.shape[1]):
                    total += (later[rows, k][:, None] - later[None, others, k]) ** 2
                value = kernel(np.sqrt(total, out=total))
                value = value if threshold is None else np.multiply(value, value >= threshold, out=value)
                out[rows] += value @ right[others]
                after = others >= many
                if after.all():
                    out[others] += value.T @ right[rows]
                elif after.any():
                    out[others[after]] += value[:, after].T @ right[rows]
            used = np.flatnonzero(out.any(axis=1))
            return part, used.tobytes(), out[used].tobytes()

        out = np.zeros(v.shape)
        for part, used, data in tasks.map(work).collect():
            out[order[ends[part] + np.frombuffer(used, np.int64)]] += np.frombuffer(data).reshape(-1, v.shape[1])
        sent.destroy()
        return w[:, None] * out

    return dot


def by_cells(spark: SparkSession, x: np.ndarray, w: np.ndarray, scale: list[float], kernel: Kernel, threshold: float | None, eta: float, most: int = CELLS) -> Callable[[np.ndarray], np.ndarray]:
    """y -> (Z Kc Z' + eta I)^-1 y, with Kc the kernel between the centres of at most `most` cells of locations, exact if there are no more locations."""
    x, w = x / np.array(scale), np.asarray(w, float)
    at = lambda width: np.unique(np.floor(x / width), axis=0, return_inverse=True)[1].ravel()
    low, high = 1e-9, 2 * float(np.ptp(x)) + 1
    cell = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    if cell.max() >= most:
        for _ in range(24):
            width = math.sqrt(low * high)
            low, high = (width, high) if at(width).max() >= most else (low, width)
        cell = at(high)
    size = np.bincount(cell, w * w)
    centre = np.stack([np.bincount(cell, w * w * x[:, k]) / size for k in range(x.shape[1])], axis=1)
    count = len(size)

    def factored(_) -> bytes:
        k = kernel(np.sqrt(sum((centre[:, None, d] - centre[None, :, d]) ** 2 for d in range(centre.shape[1]))))
        k = k if threshold is None else np.where(k >= threshold, k, 0.0)
        return np.linalg.solve(eta * np.eye(count) + k * size, k).tobytes()

    ship_package(spark)
    middle = np.frombuffer(spark.sparkContext.parallelize([0], 1).map(factored).first()).reshape(count, count)

    def solve(y: np.ndarray) -> np.ndarray:
        sums = np.stack([np.bincount(cell, w * c, count) for c in y.T], axis=1)
        return (y - w[:, None] * (middle @ sums)[cell]) / eta

    return solve


def solve(product: Callable, near: Callable, y: np.ndarray, tol: float, most: int = 1000) -> np.ndarray:
    """Right-preconditioned GMRES on all columns of y side by side; raises unless every residual falls below tol times its right side."""
    x, norm, taken = np.zeros_like(y), np.linalg.norm(y, axis=0), 0
    length = max(20, min(200, MOST_HELD // max(y.size, 1)))
    r = y.copy()
    while True:
        size = np.linalg.norm(r, axis=0)
        if (size <= tol * norm).all():
            return x
        if taken >= most:
            raise ArithmeticError(f"generalised minimal residuals did not converge within {most} steps")
        safe = np.where(size > 0, size, 1.0)
        basis, h = [r / safe], np.zeros((y.shape[1], length + 1, length))
        for step in range(length):
            v = product(near(basis[-1]))
            for _ in range(2):  # twice, against lost orthogonality
                for k, b in enumerate(basis):
                    part = (b * v).sum(axis=0)
                    h[:, k, step] += part
                    v = v - b * part
            last = h[:, step + 1, step] = np.linalg.norm(v, axis=0)
            taken += 1
            basis.append(v / np.where(last > 0, last, 1.0))
            found = [np.linalg.lstsq(h[c, : step + 2, : step + 1], np.r_[size[c], np.zeros(step + 1)], rcond=None)[0] for c in range(y.shape[1])]
            rest = [np.linalg.norm(np.r_[size[c], np.zeros(step + 1)] - h[c, : step + 2, : step + 1] @ found[c]) for c in range(y.shape[1])]
            if (np.array(rest) <= 0.5 * tol * norm).all() or taken >= most:
                break
        x = x + near(sum(b * np.array([f[k] for f in found]) for k, b in enumerate(basis[:-1])))
        r = y - product(x)
