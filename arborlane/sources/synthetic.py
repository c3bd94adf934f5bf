"""Generators over `spark.range`: each value hangs on seed, row and column alone."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import random_split


def unit(seed: int, column: int) -> Column:
    """Uniform in (0, 1) by row id."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(column), F.col("id")), 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, column: int) -> Column:
    """Standard normal by row id (Box-Muller)."""
    return F.sqrt(-2 * F.log(unit(seed, 2 * column + 10_000))) * F.cos(2 * math.pi * unit(seed, 2 * column + 10_001))


def friedman(spark: SparkSession, n_samples: int = 300_000, n_features: int = 30, noise: float = 0.5, seed: int = 123) -> DataFrame:
    """Friedman #1: id, Feature_0 ... in (0, 1) and Target; five features at least carry the signal."""
    if n_features < 5:
        raise ValueError("five features at least")
    rows = spark.range(n_samples).select("id", *[unit(seed, k).alias(f"Feature_{k}") for k in range(n_features)])
    x = [F.col(f"Feature_{k}") for k in range(5)]
    clean = 10 * F.sin(math.pi * x[0] * x[1]) + 20 * (x[2] - 0.5) * (x[2] - 0.5) + 10 * x[3] + 5 * x[4]
    return rows.withColumn("Target", clean + noise * normal(seed, 99))


def corners(n: int, dimensions: int, seed: int) -> list[list[int]]:
    """n distinct corners of the hypercube, as bits of each dimension, without a table of all corners.

    In as many dimensions as n has binary digits, dealt by the seed, a corner
    spells its number (under a random mask), so no two are the same; in the
    others its bits are random.  Raises ValueError for more corners than there are.
    """
    digits = max(1, (n - 1).bit_length())
    if n > 1 << dimensions:
        raise ValueError("more corners than the hypercube has")
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 2, (n, dimensions))
    spelt, mask = rng.permutation(dimensions)[:digits], rng.integers(0, 2, digits)
    for d, k in enumerate(spelt.tolist()):
        out[:, k] = (np.arange(n) >> d & 1) ^ mask[d]
    return out.tolist()


def classification(spark: SparkSession, n_samples: int = 300_000, n_features: int = 30, n_redundant: int = 5, clusters: int = 2, flip: float = 0.01, weights: tuple[float, float] = (0.9, 0.1), separation: float = 1.0, seed: int = 123, informative: int | None = None) -> DataFrame:
    """id, Feature_0 ... and Label: Gaussian clusters on hypercube corners, redundant linear mixes, noise, and flipped labels.

    informative: features that carry a corner's coordinates; 35 % of all if not given.
    """
    informative = informative or max(2, int(0.35 * n_features))
    redundant = min(n_redundant, n_features - informative)
    rng = np.random.default_rng(seed)
    own = corners(2 * clusters, informative, seed)
    mixes = rng.uniform(-1, 1, (redundant, informative))
    rows = spark.range(n_samples).withColumn("class", (unit(seed, 1) >= weights[0]).cast("int")).withColumn("corner", F.floor(unit(seed, 2) * clusters).cast("int") + F.col("class") * clusters)
    for k in range(informative):
        centre = F.element_at(F.array(*[F.lit(separation * (1.0 if c[k] else -1.0)) for c in own]), F.col("corner") + 1)
        rows = rows.withColumn(f"Feature_{k}", centre + normal(seed, 100 + k))
    for j in range(redundant):
        mixed = sum((F.lit(float(mixes[j, k])) * F.col(f"Feature_{k}") for k in range(1, informative)), F.lit(float(mixes[j, 0])) * F.col("Feature_0"))
        rows = rows.withColumn(f"Feature_{informative + j}", mixed)
    for k in range(informative + redundant, n_features):
        rows = rows.withColumn(f"Feature_{k}", normal(seed, 100 + k))
    label = F.when(unit(seed, 3) < flip, (unit(seed, 4) < 0.5).cast("int")).otherwise(F.col("class"))
    return rows.withColumn("Label", label.cast("tinyint")).drop("class", "corner")


def worker_shard(spark: SparkSession, worker: int, n_samples: int, seed: int = 123, task: str = "regressor", **options) -> DataFrame:
    """A worker's own data (seed + its number) with an 80/20 split."""
    make = friedman if task == "regressor" else classification
    return random_split(make(spark, n_samples=n_samples, seed=seed + worker, **options), "id", seed=seed + worker)
