"""Predictions of several models combined per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

VOTED = ("multi:softmax", "binary:hinge")


def choose_models(predictions: DataFrame, ensemble: bool = True) -> DataFrame:
    """All models, or only the first by name; names starting with a dot never count."""
    visible = predictions.where(~F.startswith("model_id", F.lit(".")))
    if ensemble:
        return visible
    first = visible.agg(F.min("model_id").alias("model_id"))
    return visible.join(F.broadcast(first), "model_id")


def ensemble_mean(predictions: DataFrame, row_id: str = "row_id", value: str = "prediction") -> DataFrame:
    """Mean over models, element by element for class scores."""
    if not dict(predictions.dtypes)[value].startswith("array"):
        return predictions.groupBy(row_id).agg(F.avg(value).alias(value))
    long = predictions.select(row_id, F.posexplode(value).alias("i", "v"))
    means = long.groupBy(row_id, "i").agg(F.avg("v").alias("v"))
    gathered = means.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("all"))
    return gathered.select(row_id, F.transform("all", lambda e: e["v"]).alias(value))


def ensemble_vote(predictions: DataFrame, row_id: str = "row_id", value: str = "prediction") -> DataFrame:
    """Most frequent class over models, the smallest on ties."""
    return predictions.groupBy(row_id).agg(F.mode(value, True).alias(value))


def combine_models(predictions: DataFrame, objective: str, row_id: str = "row_id", value: str = "prediction") -> DataFrame:
    """Vote for class outputs, mean for everything else."""
    fn = ensemble_vote if objective in VOTED else ensemble_mean
    return fn(predictions, row_id, value)
