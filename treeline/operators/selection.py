"""Labels, probabilities and scores derived from raw predictions, by objective and requested key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from treeline.functions.scores import argmax_label

# Keys that may be requested per objective.
REGRESSION_KEYS = ("predicted_score",)
PROBABILITY_KEYS = ("predicted_label", "labels", "probability", "probabilities", "raw_score", "raw_scores")
SCORE_KEYS = ("predicted_label", "labels", "raw_score", "raw_scores")
VALID_KEYS = {
    "reg:squarederror": REGRESSION_KEYS,
    "reg:logistic": REGRESSION_KEYS,
    "reg:gamma": REGRESSION_KEYS,
    "reg:absoluteerror": REGRESSION_KEYS,
    "reg:tweedie": REGRESSION_KEYS,
    "binary:logistic": PROBABILITY_KEYS,
    "binary:logitraw": SCORE_KEYS,
    "binary:hinge": SCORE_KEYS,
    "multi:softmax": SCORE_KEYS,
    "multi:softprob": PROBABILITY_KEYS,
}
_SINGLE = ("binary:logitraw", "binary:hinge", "binary:logistic", "multi:softmax")


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def select_predicted_label(objective: str, raw: Column) -> Column:
    if objective in ("binary:hinge", "multi:softmax"):
        return raw.cast("double")
    if objective == "binary:logistic":
        return (raw > 0.5).cast("int")
    if objective == "binary:logitraw":
        return (raw > 0).cast("int")
    if objective == "multi:softprob":
        return argmax_label(raw)
    return _none("int")


def select_labels(objective: str, num_class: int | None = None) -> Column:
    if objective.startswith("binary:"):
        return F.array(F.lit(0), F.lit(1))
    if objective.startswith("multi:") and num_class:
        return F.sequence(F.lit(0), F.lit(int(num_class) - 1))
    return _none("array<int>")


def select_probability(objective: str, raw: Column) -> Column:
    if objective == "multi:softprob":
        return F.array_max(raw)
    return raw.cast("double") if objective == "binary:logistic" else _none("double")


def select_probabilities(objective: str, raw: Column) -> Column:
    if objective == "multi:softprob":
        return raw
    return F.array(1.0 - raw, raw.cast("double")) if objective == "binary:logistic" else _none("array<double>")


def select_raw_score(objective: str, raw: Column) -> Column:
    if objective == "multi:softprob":
        return F.array_max(raw)
    return raw.cast("double") if objective in _SINGLE else _none("double")


def select_raw_scores(objective: str, raw: Column) -> Column:
    if objective == "multi:softprob":
        return raw
    return F.array(1.0 - raw, raw.cast("double")) if objective in _SINGLE else _none("array<double>")


def select_predicted_score(objective: str, raw: Column) -> Column:
    return raw.cast("double") if VALID_KEYS.get(objective) == REGRESSION_KEYS else _none("double")


def parse_keys(text: str) -> list[str]:
    """Requested keys from text: spaces removed, lower case, split at commas."""
    return text.replace(" ", "").lower().split(",")


def split_keys(keys: Sequence[str], objective: str) -> tuple[list[str], list[str]]:
    """Requested keys the objective can and cannot give."""
    if objective not in VALID_KEYS:
        raise ValueError(f"objective {objective} unsupported for selectable predictions")
    allowed = VALID_KEYS[objective]
    return [k for k in keys if k in allowed], [k for k in keys if k not in allowed]


def select_predictions(
    df: DataFrame, keys: Sequence[str], objective: str, num_class: int | None = None, raw: str = "prediction", output: str = "selected"
) -> DataFrame:
    """Adds a struct with the requested keys in order; a key the objective cannot give is NULL (not applicable)."""
    split_keys(keys, objective)
    column = F.col(raw)
    made = {
        "predicted_label": lambda: select_predicted_label(objective, column),
        "labels": lambda: select_labels(objective, num_class),
        "probability": lambda: select_probability(objective, column),
        "probabilities": lambda: select_probabilities(objective, column),
        "raw_score": lambda: select_raw_score(objective, column),
        "raw_scores": lambda: select_raw_scores(objective, column),
        "predicted_score": lambda: select_predicted_score(objective, column),
    }
    valid, _ = split_keys(keys, objective)
    fields = [(made[k]() if k in valid else _none("double")).alias(k) for k in keys]
    return df.withColumn(output, F.struct(*fields))
