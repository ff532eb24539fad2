"""User metrics written in Python, evaluated in pieces that add up."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# Batch functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class BatchMetric:
    """A metric in Python: ``partial`` makes numbers that add up of some rows, ``finish`` makes the value of their sums.

    ``partial`` is given one numpy array per name in ``columns`` and returns equally many numbers each time; it sees
    the rows of a key in pieces of any size, so no key has to fit into one task.
    """

    columns: Sequence[str]
    partial: Callable[..., Sequence[float]]
    finish: Callable[[np.ndarray], float]


def _runs(table: pa.Table, keys: Sequence[str]) -> Iterator[np.ndarray]:
    """Row numbers of a batch by key; NULL is a key of its own."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for key in keys:
        index = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        code = np.unique(code * (int(index.max(initial=0)) + 1) + index, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(code[order])) + 1)


def batch_metrics(df: DataFrame, metrics: dict[str, BatchMetric], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, metric, value``; one pass over the rows for all metrics, and a shuffle of their partial sums only.

    A key without rows (or an empty table) has no metrics.
    """
    held = [f"__key_{i}" for i in range(len(keys))]
    used = list(dict.fromkeys(c for m in metrics.values() for c in m.columns))
    narrow = df.select(*[F.col(k).alias(h) for k, h in zip(keys, held, strict=True)], *used)
    kinds = [f"{h} {narrow.schema[h].dataType.simpleString()}" for h in held]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            arrays = {c: table.column(c).to_numpy() for c in used}
            firsts, names, sums = [], [], []
            for rows in _runs(table, held):
                for name, metric in metrics.items():
                    firsts.append(rows[0])
                    names.append(name)
                    sums.append([float(v) for v in metric.partial(*[arrays[c][rows] for c in metric.columns])])
            out = table.select(held).take(pa.array(firsts)) if held else pa.table({})
            columns = [out.column(h).combine_chunks() for h in held]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(sums, pa.list_(pa.float64()))], [*held, "metric", "sums"])

    @F.pandas_udf("double")
    def finished(metric: pd.Series, sums: pd.Series) -> pd.Series:
        return pd.Series([float(metrics[m].finish(np.asarray(s))) for m, s in zip(metric, sums, strict=True)], dtype=float)

    parts = narrow.mapInArrow(partial, ", ".join([*kinds, "metric string", "sums array<double>"]))
    each = parts.select(*held, "metric", F.posexplode("sums").alias("at", "v"))
    summed = each.groupBy(*held, "metric", "at").agg(F.sum("v").alias("v"))
    whole = summed.groupBy(*held, "metric").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("sums"))
    named = [F.col(h).alias(k) for k, h in zip(keys, held, strict=True)]
    return whole.select(*named, "metric", finished("metric", F.col("sums")["v"]).alias("value"))
