"""Row and feature sampling that gives the same choice on every run and any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from treeline.functions.hashing import hash_int, hash_unit, local_hash_int


def keep_row(seed: int, round_number: int, row_id: Column, fraction: float, tree: int = 0) -> Column:
    """Uniform sampling: keeps a row when its hash falls below ``fraction``."""
    return hash_unit(seed, round_number, tree, row_id) < F.lit(float(fraction))


def row_subsample(df: DataFrame, row_id: str, fraction: float, seed: int = 0, round_number: int = 0) -> DataFrame:
    return df.where(keep_row(seed, round_number, F.col(row_id), fraction))


def gradient_size(g: Column, h: Column, lam: float) -> Column:
    return F.sqrt(g * g + lam * h * h)


def keep_probability(size: Column, total: float, rows: int, fraction: float) -> Column:
    """Gradient-based sampling: probability proportional to the gradient size, at most one."""
    if total <= 0:
        return F.lit(1.0)
    return F.least(F.lit(1.0), size * (fraction * rows / total))


def column_subsample(features: DataFrame, fraction: float, seed: int = 0, level: str = "-", node: str = "-", keys: tuple[str, ...] = ("tree",)) -> DataFrame:
    """``keys, feature`` kept: the ``ceil(fraction * n)`` features (at least one) with the smallest hashes per key."""
    w = W.partitionBy(*keys)
    ranked = features.select(
        *keys, "feature",
        F.row_number().over(w.orderBy(hash_int(seed, *[F.col(k) for k in keys], level, node, F.col("feature")), "feature")).alias("r"),
        F.count(F.lit(1)).over(w).alias("n"),
    )
    return ranked.where(F.col("r") <= F.greatest(F.ceil(F.col("n") * float(fraction)), F.lit(1))).select(*keys, "feature")


def choose_features(features: list[int], fraction: float, *parts) -> list[int]:
    """The same rule for the training loop, over feature numbers on the driver."""
    if fraction >= 1.0:
        return features
    count = max(1, math.ceil(fraction * len(features)))
    return sorted(sorted(features, key=lambda f: (local_hash_int(*parts, f), f))[:count])
