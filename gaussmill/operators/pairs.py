"""Pairs of points, and correlation matrices as rows (i, j, v).

Dense pairs come from an equi-join of point blocks, so no side is broadcast
whole and work spreads over blocks^2 / 2 tasks.  Tapered pairs come from a grid
whose cells are as wide as the kernel's reach: points meet only points of
neighbouring cells, and the exact test k >= threshold follows.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaussmill.functions.basis import coordinates
from gaussmill.functions.kernels import Kernel
from gaussmill.functions.special import ball_radius, ball_volume

BLOCKS, MOST_GRID_DIMENSIONS = 8, 3
#: The column of `located` points with the root of the number of points at a location.
WEIGHT = "root_copies"


def scales(scale, dimension: int) -> list[float]:
    """One positive scale per dimension."""
    out = [float(s) for s in scale] if hasattr(scale, "__len__") else [float(scale)] * dimension
    if len(out) == 1:
        out *= dimension
    if len(out) != dimension or min(out) <= 0:
        raise ValueError(f"the scale needs 1 or {dimension} positive values")
    return out


def taper_threshold(density: float, n: int, dimension: int, scale, kernel: Kernel) -> float:
    """The kernel value at the radius inside which about a share `density` of n points in the unit cube lies."""
    adjacency = density * n
    if adjacency < 1:
        raise ValueError("the density is too small: no neighbours would be left")
    mean = math.exp(sum(map(math.log, scales(scale, dimension))) / dimension)
    radius = ball_radius(adjacency / ball_volume(mean, dimension), dimension)
    import numpy as np

    return float(kernel(np.array([radius / (n ** (1 / dimension) - 1)]))[0])


def _named(points: DataFrame, side: str) -> DataFrame:
    return points.select(F.col("i").alias(f"{side}_i"), *[F.col(c).alias(f"{side}_{c}") for c in points.columns if c == WEIGHT or c in coordinates(points)])


def located(points: DataFrame) -> DataFrame:
    """Distinct locations (i, x0, .., root_copies), each with the smallest index of its points.

    With Q of orthonormal columns, one for a location and one over the root of its copies at each of its points, the points' K is Q M Q' and
    M, `correlation` of these rows, has K's entries times both roots.  What is orthogonal to Q, as many dimensions as there are
    surplus copies, K maps to zero.
    """
    return points.groupBy(*coordinates(points)).agg(F.min("i").alias("i"), F.sqrt(F.count("*").cast("double")).alias(WEIGHT)).select("i", *coordinates(points), WEIGHT)


def dense_pairs(points: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Rows (a_i, a_x.., b_i, b_x..) of all pairs with a_i <= b_i."""
    block = F.pmod(F.hash("i"), F.lit(blocks))
    one = points.withColumn("own", block)
    left = _named(points, "a").withColumn("own", F.pmod(F.hash("a_i"), F.lit(blocks)))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = _named(one, "b").withColumn("own", F.pmod(F.hash("b_i"), F.lit(blocks)))
    right = right.withColumnRenamed("own", "other").withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.join(right, ["own", "other"]).where("a_i <= b_i").drop("own", "other")


def cross_pairs(points: DataFrame, tests: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Rows (a_.., b_..) of all pairs of a point and a test point, by blocks of points."""
    left = _named(points, "a").withColumn("own", F.pmod(F.hash("a_i"), F.lit(blocks)))
    right = _named(tests, "b").withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.join(right, "own").drop("own")


def near_pairs(points: DataFrame, tests: DataFrame | None, scale: list[float], reach: float) -> DataFrame:
    """Pairs whose scaled distance may be within the reach; with a_i <= b_i if there are no test points."""
    width = reach * (1 + 1e-9)
    names = coordinates(points)

    def cells(side: str, spread: bool) -> list[Column]:
        out = []
        for k, (c, s) in enumerate(zip(names, scale, strict=True)):
            cell = F.floor(F.col(f"{side}_{c}") / F.lit(s * width)).cast("long")
            out.append((cell + F.col("o")[k] if spread else cell).alias(f"g{k}"))
        return out

    offsets = F.array(*[F.array(*map(F.lit, o)) for o in product((-1, 0, 1), repeat=len(names))])
    left = _named(points, "a").withColumn("o", F.explode(offsets))
    left = left.select("*", *cells("a", True)).drop("o")
    right = _named(points if tests is None else tests, "b")
    right = right.select("*", *cells("b", False))
    keys = [f"g{k}" for k in range(len(names))]
    out = left.join(right, keys).drop(*keys)
    return out if tests is not None else out.where("a_i <= b_i")


def distance(names: list[str], scale: list[float]) -> Column:
    total = F.lit(0.0)
    for c, s in zip(names, scale, strict=True):
        d = (F.col(f"a_{c}") - F.col(f"b_{c}")) / F.lit(s)
        total = total + d * d
    return F.sqrt(total)


def derivative_columns(kernel: Kernel, names: list[str], scale: list[float], order: int) -> dict[str, Column]:
    """d0, d1, ... by each scale, and h00, h01, ... by pairs of scales, of k(r); zero where r is.

    With r_p = -D_p^2 / (r s_p^3): dk = k' r_p, and
    d2k = k'' r_p r_q + k' r_pq, r_pp = (D_p^2 / (r s_p^3)) (3 / s_p + r_p / r), r_pq = (D_p^2 / (r^2 s_p^3)) r_q.
    """
    r, out = F.col("r"), {}
    square = [(F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) / F.lit(s**3) for c, s in zip(names, scale, strict=True)]
    slope = [-q / r for q in square]
    for p in range(len(names)):
        if order >= 1:
            out[f"d{p}"] = F.when(r > 0, kernel(r, 1) * slope[p]).otherwise(F.lit(0.0))
        for q in range(p, len(names) if order >= 2 else 0):
            bend = square[p] / r * (F.lit(3.0 / scale[p]) + slope[p] / r) if p == q else square[p] / (r * r) * slope[q]
            out[f"h{p}{q}"] = F.when(r > 0, kernel(r, 2) * slope[p] * slope[q] + kernel(r, 1) * bend).otherwise(F.lit(0.0))
    return out


def correlation(points: DataFrame, scale, kernel: Kernel, *, order: int = 0, threshold: float | None = None, tests: DataFrame | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Rows (i, j, v) with i <= j, or (i, t, v) for test points; with d.. and h.. columns for order 1 and 2.

    With a threshold only entries k >= threshold are kept, and derivatives share
    their pattern.  The grid join serves up to three dimensions and kernels of
    finite reach; otherwise all pairs are tested.  Of `located` points entries
    are kept by the kernel and then weighted.
    """
    if order not in (0, 1, 2):
        raise NotImplementedError("derivatives of order 0, 1 and 2 exist")
    names = coordinates(points)
    s = scales(scale, len(names))
    reach = kernel.reach(threshold) if threshold is not None else math.inf
    if math.isfinite(reach) and 0 < reach and len(names) <= MOST_GRID_DIMENSIONS:
        pairs = near_pairs(points, tests, s, reach)
    else:
        pairs = dense_pairs(points, blocks) if tests is None else cross_pairs(points, tests, blocks)
    pairs = pairs.withColumn("r", distance(names, s))
    weight = [(F.col(f"a_{WEIGHT}") * F.col(f"b_{WEIGHT}")).alias("weight")] if WEIGHT in points.columns else []
    if weight and tests is not None:
        raise ValueError("located points have no rows for test points")
    out = pairs.select(F.col("a_i").alias("i"), F.col("b_i").alias("j" if tests is None else "t"), kernel(F.col("r")).alias("v"), *[c.alias(k) for k, c in derivative_columns(kernel, names, s, order).items()], *weight)
    out = out if threshold is None else out.where(F.col("v") >= threshold)
    if WEIGHT not in points.columns:
        return out
    return out.select("i", "j", *[(F.col(c) * F.col("weight")).alias(c) for c in out.columns if c not in ("i", "j", "weight")])


def mirrored(upper: DataFrame) -> DataFrame:
    """Both triangles from rows with i <= j."""
    names = [c for c in upper.columns if c not in ("i", "j")]
    return upper.unionByName(upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), *names))


def statistics(upper: DataFrame, n: int) -> DataFrame:
    """nnz, density and average entries of a row of the whole matrix: one row."""
    nnz = F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(2)), F.lit(0)).cast("long")
    return densities(upper.agg(nnz.alias("nnz")), n)


def densities(counted: DataFrame, n: int) -> DataFrame:
    """What `statistics` gives, from one row (nnz)."""
    return counted.select("nnz", (F.col("nnz") / float(n * n)).alias("density"), (F.col("nnz") / float(n)).alias("average_row_nnz"))
