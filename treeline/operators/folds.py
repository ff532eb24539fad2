"""Fold assignment and slicing; repeatable for a seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeline.functions.hashing import digest
from treeline.operators.ordering import hash_position


def _repeated(df: DataFrame, row_id: str, repeats: int, seed: int) -> DataFrame:
    df = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return df.withColumn("__hash", digest(seed, F.col("repeat"), F.col(row_id)))


def kfold_assign(df: DataFrame, row_id: str, k: int, repeats: int = 1, seed: int = 0, digits: int | None = None) -> DataFrame:
    """Adds ``repeat, fold``: each row once per repeat, fold sizes differ by at most one."""
    ordered = hash_position(_repeated(df, row_id, repeats, seed), "__hash", [row_id], keys=["repeat"], digits=digits)
    return ordered.withColumn("fold", F.pmod("position", F.lit(k)).cast("int")).drop("position", "__hash")


def stratified_kfold_assign(df: DataFrame, row_id: str, label: str, k: int, repeats: int = 1, seed: int = 0, digits: int | None = None) -> DataFrame:
    """As ``kfold_assign`` within each class; the next class continues where the last one stopped."""
    ordered = hash_position(
        _repeated(df, row_id, repeats, seed), "__hash", [row_id], keys=["repeat"], lead=[label], digits=digits
    )
    return ordered.withColumn("fold", F.pmod("position", F.lit(k)).cast("int")).drop("position", "__hash")


def fold_slice(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training rows (not in the fold) and held-out rows (in the fold)."""
    return df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)
