"""Any accepted metric by name, as one number, for the training loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeline.functions.scores import argmax_label
from treeline.operators import confusion, ranking
from treeline.operators.gradients import is_multiclass, link


def evaluate_named(df: DataFrame, metric: str, objective: str, margins: list[str], params: dict, bounds: list[float] | None = None) -> float:
    """Metrics that need an order or a confusion frame; per-row metrics are handled in one pass elsewhere.

    ``bounds`` cut the range of event times, if they are known.
    """
    name, _, at = metric.partition("@")
    name = name.strip()
    columns = [F.col(m) for m in margins]
    top = int(float(at)) if at else None
    if name in ("auc", "aucpr"):
        fn = ranking.eval_auc if name == "auc" else ranking.eval_aucpr
        return fn(df, margins[0], "label", "w").first()[0]
    if name in ("map", "ndcg"):
        fn = ranking.eval_map if name == "map" else ranking.eval_ndcg
        return fn(df, "group_id", margins[0], "label", top).first()[0]
    if name == "cox-nloglik":
        return ranking.eval_cox_nloglik(df, margins[0], "label", bounds).first()[0]
    if name in confusion.CLASS_METRICS:
        pred = argmax_label(F.array(*columns)) if is_multiclass(objective) else (columns[0] > 0).cast("int")
        counts = confusion.confusion_counts(df.withColumn("pred", pred))
        return confusion.class_metrics(counts, [name]).first()[0]
    if name in confusion.VALUE_METRICS:
        return confusion.value_metrics(df.withColumn("pred", link(objective, columns)), [name]).first()[0]
    raise ValueError(f"unknown metric: {metric}")
