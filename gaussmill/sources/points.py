"""Point frames: rows (i, x0, x1, ..., z?), from generators or from tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaussmill.functions.basis import coordinates


def checked(points: DataFrame) -> DataFrame:
    """Coordinates as doubles; a null index or coordinate raises when the row is read."""
    names = coordinates(points)
    if "i" not in points.columns or not names:
        raise ValueError("points have an index i and coordinates x0, x1, ...")
    test = F.col("i").isNull()
    for c in names:
        test = test | F.col(c).isNull()
    index = F.when(test, F.raise_error(F.lit("a point has a null index or coordinate")).cast("long")).otherwise(F.col("i").cast("long"))
    rest = [F.col(c) for c in points.columns if c != "i" and c not in names]
    return points.select(index.alias("i"), *[F.col(c).cast("double").alias(c) for c in names], *rest)


def _box(a, b, contrast: float, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    if not 0 <= contrast <= 1:
        raise ValueError("contrast lies between 0 and 1")
    low = np.broadcast_to(np.asarray(0.0 if a is None else a, float), (dimension,))
    high = np.broadcast_to(np.asarray(1.0 if b is None else b, float), (dimension,))
    if (low < 0).any() or (high > 1).any() or (low > high).any():
        raise ValueError("the box lies in the unit cube")
    return low, high


def lattice(spark: SparkSession, per_axis: int, dimension: int = 1, low=0.0, high=1.0) -> DataFrame:
    """per_axis^dimension points on a grid of a box, the first coordinate fastest; by index arithmetic on spark.range."""
    low, high = np.broadcast_to(np.asarray(low, float), (dimension,)), np.broadcast_to(np.asarray(high, float), (dimension,))
    step = (high - low) / max(1, per_axis - 1)
    cell = lambda k: F.floor(F.col("id") / float(per_axis**k)) % per_axis
    return spark.range(per_axis**dimension).select(F.col("id").alias("i"), *[(F.lit(float(low[k])) + cell(k) * F.lit(float(step[k]))).alias(f"x{k}") for k in range(dimension)])


def generate_points(spark: SparkSession, num_points: int, dimension: int = 1, grid: bool = False, a=None, b=None, contrast: float = 0.0, seed: int = 0) -> DataFrame:
    """Points in the unit cube; a share `contrast` of them drawn inside the box [a, b].

    With `grid`, num_points counts per axis.  Random points are drawn on the
    driver by a seeded generator, inner and outer ones with one seed.
    """
    if isinstance(num_points, bool) or not isinstance(num_points, int) or num_points < 1 or dimension < 1:
        raise ValueError("num_points and dimension are positive integers")
    low, high = _box(a, b, contrast, dimension)
    inner = round(num_points * contrast) if contrast and a is not None and b is not None else 0
    clouds = [(inner, low, high)] * (inner > 0) + [(num_points - inner, np.zeros(dimension), np.ones(dimension))] * (num_points > inner)
    if grid:
        out, before = None, 0
        for n, lo, hi in clouds:
            part = lattice(spark, n, dimension, lo, hi).withColumn("i", F.col("i") + F.lit(before))
            out, before = part if out is None else out.unionByName(part), before + n**dimension
        return out
    drawn = np.vstack([lo + np.random.RandomState(seed).rand(n, dimension) * (hi - lo) for n, lo, hi in clouds])
    return spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(drawn)], "i long, " + ", ".join(f"x{k} double" for k in range(dimension)))


def generate_data(points: DataFrame, noise_magnitude: float = 0.0, seed: int = 0) -> DataFrame:
    """z = sum of sin(pi x_k), plus seeded normal noise."""
    smooth = sum((F.sin(F.col(c) * math.pi) for c in coordinates(points)), F.lit(0.0))
    return points.withColumn("z", smooth + F.randn(seed) * noise_magnitude if noise_magnitude else smooth)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 points in two dimensions with z the length of the name."""
    t = read(spark, sf_dir, "nation")
    return t.select(F.col("n_nationkey").cast("long").alias("i"), (F.col("n_nationkey") / 25.0).alias("x0"), (F.col("n_regionkey") / 5.0).alias("x1"), F.length("n_name").cast("double").alias("z"))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "supplier")
    x0, x1 = F.col("s_acctbal") / 10000.0, F.col("s_nationkey") / 25.0
    return t.select(F.col("s_suppkey").alias("i"), x0.alias("x0"), x1.alias("x1"), (F.sin(x0 * math.pi) + F.cos(x1 * 7.0) / 5.0).alias("z"))


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "customer")
    return t.select(F.col("c_custkey").alias("i"), (F.col("c_acctbal") / 10000.0).alias("x0"), (F.col("c_nationkey") / 25.0).alias("x1"))


def quantity_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct scalars for kernels and densities."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50.0).alias("x")).distinct()
