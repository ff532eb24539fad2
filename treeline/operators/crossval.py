"""Out-of-fold predictions in long form ``row_id, repeat, fold, pred[, prob]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from treeline.functions.scores import argmax_label

EXAMPLE_ROWS = 100


def attach_predictions(rows: DataFrame, predictions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Predictions joined to their rows by id, never by position; a row without one keeps its place, with NULL.

    ``check_complete`` tells whether every row has its predictions.
    """
    return rows.join(predictions, row_id, "left")


def recorded_columns(raw: Column, is_array: bool, classification: bool, objective: str | None = None) -> tuple[Column, Column]:
    """Label (or value) and probability kept for one raw prediction."""
    if not classification:
        return raw.cast("double"), F.lit(None).cast("double")
    if is_array:
        return argmax_label(raw).cast("double"), F.array_max(raw)
    if objective == "multi:softmax":
        return raw.cast("double"), F.lit(None).cast("double")
    return (raw > 0.5).cast("double"), raw.cast("double")


def cv_repeat_index(predictions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Adds ``n``: which prediction of its row this is. A row has at most a few repeats, so groups are tiny."""
    return predictions.withColumn("n", F.row_number().over(W.partitionBy(row_id).orderBy("repeat", "fold")))


def cv_repeated_rows(predictions: DataFrame, repeats: int, row_id: str = "row_id", examples: int = EXAMPLE_ROWS) -> DataFrame:
    """Example rows predicted more often than ``repeats``."""
    return predictions.groupBy(row_id).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > repeats).limit(examples)


def cv_incomplete_rows(rows: DataFrame, predictions: DataFrame, repeats: int, row_id: str = "row_id") -> DataFrame:
    """Rows with a number of predictions other than ``repeats`` (0 included)."""
    counts = predictions.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"))
    joined = rows.select(row_id).join(counts, row_id, "left")
    return joined.select(row_id, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).where(F.col("n") != repeats)


def check_complete(rows: DataFrame, predictions: DataFrame, repeats: int, row_id: str = "row_id") -> None:
    """Error naming up to 100 rows when predictions are missing or repeated."""
    bad = cv_incomplete_rows(rows, predictions, repeats, row_id).limit(EXAMPLE_ROWS).collect()
    if bad:
        raise ValueError(
            f"number of predictions is not {repeats} for some rows, for example {[r[row_id] for r in bad]}"
        )


def cv_aggregate_predictions(predictions: DataFrame, classification: bool, row_id: str = "row_id", label: str = "label") -> DataFrame:
    """Mean probability and modal class per row (ties: the smallest), or the mean prediction."""
    grouped = predictions.groupBy(row_id)
    y = F.first(label).alias("label")
    if classification:
        return grouped.agg(y, F.avg("prob").alias("prob"), F.mode("pred", True).alias("pred"))
    return grouped.agg(y, F.avg("pred").alias("pred"))


def cv_metric_summary(log: DataFrame, decimals: int = 5) -> DataFrame:
    """Mean over folds of each fold's last value: ``data_name, metric, value``."""
    last = log.groupBy("data_name", "metric", "fold").agg(F.max_by("value", "round").alias("value"))
    return last.groupBy("data_name", "metric").agg(F.round(F.avg("value"), decimals).alias("value"))


def early_stopping_round(log: DataFrame, patience: int, maximize: bool, keys: tuple[str, ...] = ("fold", "data_name", "metric")) -> DataFrame:
    """Per key: best round, its value, and the round at which training stops.

    An improvement is strictly better than all rounds before. Training stops at the first round that is
    ``patience`` rounds after the best one so far; without such a round it runs to the last.
    """
    past = W.partitionBy(*keys).orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("round").rowsBetween(W.unboundedPreceding, -1)
    extreme = F.max if maximize else F.min
    prior = extreme("value").over(before)
    better = prior.isNull() | ((F.col("value") > prior) if maximize else (F.col("value") < prior))
    marked = log.withColumn("__best", F.when(better, F.col("round")))
    marked = marked.withColumn("best_so_far", F.max("__best").over(past))
    marked = marked.withColumn("stop", F.col("round") - F.col("best_so_far") >= patience)
    stop = F.coalesce(F.min(F.when(F.col("stop"), F.col("round"))), F.max("round"))
    stops = marked.groupBy(*keys).agg(stop.alias("stop_round"))
    until = marked.join(stops, list(keys)).where(F.col("round") <= F.col("stop_round"))
    return until.groupBy(*keys).agg(
        F.max("best_so_far").alias("best_round"),
        F.max_by("value", F.when(F.col("round") == F.col("best_so_far"), F.col("round"))).alias("best_value"),
        F.first("stop_round").alias("stop_round"),
    )
