"""Classification and regression metrics derived from one confusion frame or one aggregate.

Labels and predictions are columns; ``keys`` are optional grouping columns (fold, data set, slice).
All class metrics read the confusion counts, whose size is classes squared, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from treeline.operators.batch_metrics import BatchMetric, batch_metrics

CLASS_METRICS = (
    "accuracy", "balanced_accuracy", "f1", "f1_binary", "f1_macro", "precision", "precision_macro",
    "precision_micro", "recall", "recall_macro", "recall_micro",
)
VALUE_METRICS = ("mae", "mse", "rmse", "r2")
ALL_METRICS = CLASS_METRICS + VALUE_METRICS
_BINARY_ONLY = ("f1_binary", "precision", "recall")


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    """``keys, label, pred, n``; row weights are not used by these metrics."""
    return df.groupBy(*keys, F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def class_report(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per class ``tp, actual, predicted, precision, recall, f1``; classes = actual or predicted."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("tp")),
            F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
        )
    ).alias("s")
    per = (
        counts.select(*keys, sides)
        .groupBy(*keys, F.col("s.class").alias("class"))
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.actual").alias("actual"), F.sum("s.predicted").alias("predicted"))
    )
    return per.select(
        *keys, "class", "tp", "actual", "predicted",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("actual")).alias("recall"),
        _ratio(2.0 * F.col("tp"), F.col("actual") + F.col("predicted")).alias("f1"),
    )


def _class_aggregates(names: Sequence[str]) -> dict[str, Column]:
    one = F.col("class") == 1
    tp, actual, predicted = F.sum("tp"), F.sum("actual"), F.sum("predicted")
    multiclass = (F.count(F.lit(1)) > 2) | (F.max("class") > 1)

    def binary(value: str) -> Column:
        error = F.raise_error(F.lit("Target is multiclass but average='binary'")).cast("double")
        return F.when(multiclass, error).otherwise(F.coalesce(F.max(F.when(one, F.col(value))), F.lit(0.0)))

    every = {
        "accuracy": lambda: _ratio(tp, actual),
        "balanced_accuracy": lambda: F.coalesce(F.avg(F.when(F.col("actual") > 0, F.col("recall"))), F.lit(0.0)),
        "f1": lambda: F.avg("f1"),
        "f1_macro": lambda: F.avg("f1"),
        "f1_binary": lambda: binary("f1"),
        "precision": lambda: binary("precision"),
        "precision_macro": lambda: F.avg("precision"),
        "precision_micro": lambda: _ratio(tp, predicted),
        "recall": lambda: binary("recall"),
        "recall_macro": lambda: F.avg("recall"),
        "recall_micro": lambda: _ratio(tp, actual),
    }
    return {n: F.coalesce(every[n]().cast("double"), F.lit(0.0)) for n in names}


def class_metrics(counts: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key (one row in all without keys), one column per metric name."""
    aggregates = [c.alias(n) for n, c in _class_aggregates(names).items()]
    report = class_report(counts, keys)
    return report.groupBy(*keys).agg(*aggregates) if keys else report.agg(*aggregates)


def _value_aggregates(names: Sequence[str], label: str, pred: str) -> list[Column]:
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    err = y - p
    sse, sst = F.sum(err * err), F.var_pop(y) * F.count(y)
    constant = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    every = {
        "mae": F.avg(F.abs(err)),
        "mse": F.avg(err * err),
        "rmse": F.sqrt(F.avg(err * err)),
        "r2": F.when(F.count(y) == 0, F.lit(0.0)).when(F.max(y) == F.min(y), constant).otherwise(1.0 - sse / sst),
    }
    return [F.coalesce(every[n], F.lit(0.0)).alias(n) for n in names]


def value_metrics(df: DataFrame, names: Sequence[str], label: str = "label", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    """Regression metrics in one aggregate; an empty input gives 0.0."""
    aggregates = _value_aggregates(names, label, pred)
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def _melt(wide: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")
    return wide.select(*keys, pairs).select(*keys, "m.metric", "m.value")


def tuning_metrics(tuning_metric: str | None) -> list[str]:
    """Metric names of a tuning objective such as ``validation:f1`` or ``validation:f1,accuracy``."""
    return [n.strip() for n in tuning_metric.split(":", 1)[-1].split(",")] if tuning_metric else []


def metric_names(tuning_metric: str | None, user_metrics: Sequence[str] | None) -> list[str]:
    """Metrics to evaluate: one list as given, or the sorted union of both."""
    tuned, user = tuning_metrics(tuning_metric), list(user_metrics or [])
    return sorted(set(tuned) | set(user)) if tuned and user else tuned or user


def _kinds(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Names of class metrics and of value metrics, sorted."""
    unknown = sorted(set(names) - set(ALL_METRICS))
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    names = sorted(set(names))
    return [n for n in names if n in CLASS_METRICS], [n for n in names if n in VALUE_METRICS]


def metric_report(
    df: DataFrame,
    names: Sequence[str] = ALL_METRICS,
    label: str = "label",
    pred: str = "pred",
    value: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``keys, metric, value`` for many metrics at once.

    Class metrics compare ``label`` with ``pred``; regression metrics compare ``label`` with ``value``
    (default ``pred``). Each kind costs one aggregate over the rows, whatever the number of names.
    """
    by_class, by_value = _kinds(names)
    parts = []
    if by_class:
        wide = class_metrics(confusion_counts(df, label, pred, keys), by_class, keys)
        parts.append(_melt(wide, by_class, keys))
    if by_value:
        parts.append(_melt(value_metrics(df, by_value, label, value or pred, keys), by_value, keys))
    out = parts[0]
    for extra in parts[1:]:
        out = out.unionByName(extra)
    return out


def _grouping_sets(keys: Sequence[str], totals: str) -> list[list[str]]:
    if totals == "rollup":
        return [list(keys[:n]) for n in range(len(keys), -1, -1)]
    if totals == "cube":
        return [list(c) for n in range(len(keys), -1, -1) for c in combinations(keys, n)]
    raise ValueError(f"totals are rollup or cube, not {totals}")


def metric_report_grouped(
    df: DataFrame, keys: Sequence[str], names: Sequence[str] = ALL_METRICS, totals: str | None = None,
    label: str = "label", pred: str = "pred", value: str | None = None,
) -> DataFrame:
    """The report per data set and fold (or any other slice), in one grouped pass.

    ``totals`` (``rollup`` or ``cube``) adds the reports over all values of some keys, which are NULL there. The column
    ``grouping_id`` then has a bit for every key that is summed over, the last key's being the lowest, so that a NULL
    of the data stays apart. Class metrics of totals come from the confusion counts of the slices, not from the rows.
    """
    if totals is None:
        return metric_report(df, names, label, pred, value, keys)
    sets, named, parts = _grouping_sets(keys, totals), [*keys, "grouping_id"], []
    by_class, by_value = _kinds(names)
    if by_class:
        counts = confusion_counts(df, label, pred, keys)
        every = counts.groupingSets([[*s, "label", "pred"] for s in sets], *keys, "label", "pred")
        cells = every.agg(F.sum("n").alias("n"), F.shiftright(F.grouping_id(), 2).cast("int").alias("grouping_id"))
        parts.append(_melt(class_metrics(cells, by_class, named), by_class, named))
    if by_value:
        wide = df.groupingSets(sets, *keys).agg(*_value_aggregates(by_value, label, value or pred), F.grouping_id().cast("int").alias("grouping_id"))
        parts.append(_melt(wide, by_value, named))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def user_metric(df: DataFrame, metrics: dict[str, Column | BatchMetric], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, metric, value`` of named user metrics: aggregate Columns, and metrics in Python (``BatchMetric``).

    Each kind takes one pass over the rows for all of its metrics.
    """
    columns = {n: m for n, m in metrics.items() if not isinstance(m, BatchMetric)}
    batched = {n: m for n, m in metrics.items() if isinstance(m, BatchMetric)}
    parts = []
    if columns:
        aggregates = [c.cast("double").alias(n) for n, c in columns.items()]
        wide = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
        parts.append(_melt(wide, list(columns), keys))
    if batched:
        parts.append(batch_metrics(df, batched, keys))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
