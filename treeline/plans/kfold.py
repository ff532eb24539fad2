"""Repeated k-fold training: one model per fold and repeat, out-of-fold predictions, fold log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from treeline.operators.crossval import recorded_columns
from treeline.operators.folds import fold_slice, kfold_assign, stratified_kfold_assign
from treeline.operators.gradients import is_multiclass
from treeline.plans.boosting import fit_boosted_trees
from treeline.plans.model import Model, save_model
from treeline.plans.scoring import predict_trees
from treeline.sources.tables import union_channels


@dataclass
class Folds:
    models: list[Model] = field(default_factory=list)
    predictions: DataFrame | None = None
    log: list[tuple] = field(default_factory=list)

    def save(self, spark, path: str) -> None:
        for i, model in enumerate(self.models):
            save_model(model, spark, path, f"model-{i}")


def is_classification(params: dict) -> bool:
    return params.get("num_class") is not None or str(params.get("objective", "")).startswith("binary:")


def fit_kfold(train: DataFrame, params: dict, validation: DataFrame | None = None) -> Folds:
    """``_kfold`` folds times ``_num_cv_round`` repeats over train and validation together (needs ``row_id``).

    Each fold is evaluated on its training rows and on the held-out rows, and on the whole validation set if
    there is one. Ids must be unique over both channels.
    """
    k, repeats = int(params["_kfold"]), int(params.get("_num_cv_round", 1))
    seed = int(params.get("seed", 0))
    classes = is_classification(params)
    both = union_channels(train, validation).drop("channel")
    assign = stratified_kfold_assign(both, "row_id", "label", k, repeats, seed) if classes else kfold_assign(both, "row_id", k, repeats, seed)
    rows = assign.persist(StorageLevel.MEMORY_AND_DISK)
    objective = params.get("objective", "reg:squarederror")
    is_array = objective == "multi:softprob"
    out = Folds()
    for repeat in range(repeats):
        mine = rows.where(F.col("repeat") == repeat)
        for fold in range(k):
            fit, held = fold_slice(mine, fold)
            sets = {"held_out": held.drop("fold", "repeat")}
            model = fit_boosted_trees(
                fit.drop("fold", "repeat"), params, validation=validation, watch=sets, fold=repeat * k + fold
            )
            out.models.append(model)
            out.log += model.log
            scored = predict_trees(held, model)
            pred, prob = recorded_columns(F.col("prediction"), is_array, classes or is_multiclass(objective), objective)
            part = scored.select("row_id", "repeat", "fold", "label", pred.alias("pred"), prob.alias("prob"))
            out.predictions = part if out.predictions is None else out.predictions.unionByName(part)
    return out
