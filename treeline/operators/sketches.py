"""Weighted quantile sketch per feature: summaries of (value, mass) that merge in a tree.

A summary holds at most ``POINTS * max_bin`` values, each with the mass of the values it stands for. While it holds every
value it is exact. Beyond that, values are joined so that no rank moves by more than one part in ``POINTS * max_bin`` of
its mass; values heavier than that stay by themselves. A task merges its batches pairwise by level, like a binary
counter, so its error grows with the logarithm of its rows; tasks are merged in two further steps. What a task ships and
a group holds is bounded, whatever the number of rows of a feature.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from treeline.operators.histograms import feature_values

# Batch functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

POINTS = 32
GROUPS = 64
_SUMMARY = "feature int, part int, values array<double>, mass array<double>"


def merge(values: list[np.ndarray], mass: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """One summary of at most ``size`` values in place of several."""
    kept, at = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(mass), minlength=len(kept))
    if len(kept) <= size:
        return kept, total
    ends = np.cumsum(total)
    part = np.minimum(((ends - total) / ends[-1] * size).astype(np.int64), size - 1)
    last = np.append(part[1:] != part[:-1], True)
    return kept[last], np.diff(ends[last], prepend=0.0)


def _table(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    arrays = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())]
    arrays += [pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in (2, 3)]
    return pa.RecordBatch.from_arrays(arrays, ["feature", "part", "values", "mass"])


def summaries(long: DataFrame, size: int) -> DataFrame:
    """``feature, part, values, mass``: one summary per feature of ``feature int, value double, w double`` rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            feature, value, mass = (np.asarray(c) for c in batch.columns)
            order = np.argsort(feature, kind="stable")
            own, start = np.unique(feature[order], return_index=True)
            for f, rows in zip(own.tolist(), np.split(order, start[1:]), strict=True):
                held, level = levels.setdefault(f, {}), 0
                new = merge([value[rows]], [mass[rows]], size)
                while level in held:
                    other = held.pop(level)
                    new, level = merge([other[0], new[0]], [other[1], new[1]], size), level + 1
                held[level] = new
        for f, held in levels.items():
            values, mass = merge([v for v, _ in held.values()], [m for _, m in held.values()], size)
            yield _table([(f, TaskContext.get().partitionId() % GROUPS, values, mass)])

    def join(table: pa.Table) -> pa.Table:
        values = [np.asarray(v.values, dtype=float) for v in table.column("values")]
        mass = [np.asarray(m.values, dtype=float) for m in table.column("mass")]
        out = merge(values, mass, size)
        return pa.Table.from_batches([_table([(table.column("feature")[0].as_py(), 0, *out)])])

    long = long.where((F.col("w") > 0) & ~F.isnan("w")).select(F.col("feature").cast("int"), F.col("value").cast("double"), "w")
    parts = long.mapInArrow(summarise, _SUMMARY).groupBy("feature", "part").applyInArrow(join, _SUMMARY)
    return parts.groupBy("feature").applyInArrow(join, _SUMMARY)


def weighted_feature_bins(df: DataFrame, max_bin: int = 256, features: str = "features", weight: str = "weight") -> DataFrame:
    """``feature, cuts, mass``: ascending cut points above the least value, at even steps of the row weights' sum.

    A feature with at most ``max_bin`` values is cut at every value above its least. Missing values, and rows whose
    weight is missing or not above zero, take no part; a feature without rows has no line.
    """
    bins = max(int(max_bin), 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, m in zip(batch.column("values"), batch.column("mass"), strict=True):
                values, ends = np.asarray(v.values), np.cumsum(np.asarray(m.values))
                if len(values) <= bins:
                    cuts = values[1:]
                else:
                    steps = np.searchsorted(ends, ends[-1] * np.arange(1, bins) / bins)
                    cuts = np.unique(values[np.minimum(steps, len(values) - 1)])
                    cuts = cuts[cuts > values[0]]
                out.append((cuts, float(ends[-1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("feature"), pa.array([x[0] for x in out], pa.list_(pa.float64())), pa.array([x[1] for x in out], pa.float64())], ["feature", "cuts", "mass"]
            )

    long = feature_values(df, features, [F.col(weight).cast("double").alias("w")])
    return summaries(long, POINTS * bins).mapInArrow(cut, "feature int, cuts array<double>, mass double")


def weighted_medians(long: DataFrame, size: int = 10_000) -> DataFrame:
    """``feature, median`` of ``feature, value, w`` rows: the least value that has half of the mass at or below it.

    Exact up to ``size`` values per feature; beyond, off by a few parts in ``size`` of its mass at most.
    """

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, m in zip(batch.column("values"), batch.column("mass"), strict=True):
                ends = np.cumsum(np.asarray(m.values))
                out.append(float(np.asarray(v.values)[np.searchsorted(ends, ends[-1] / 2)]))
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(out, pa.float64())], ["feature", "median"])

    return summaries(long, size).mapInArrow(middle, "feature int, median double")
