"""Saving after rounds and continuing from the newest saved round."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeline.plans.boosting import fit_boosted_trees
from treeline.plans.model import Model, load_model, save_model

CHECKPOINT = re.compile(r"^checkpoint\.([0-9]+)$")


def checkpoint_rounds(names: list[str]) -> list[int]:
    """Round numbers of checkpoint names in numeric order; other names do not count."""
    return sorted(int(m.group(1)) for m in map(CHECKPOINT.match, names) if m)


def stored_rounds(spark: SparkSession, path: str) -> list[int]:
    """Rounds whose checkpoint was completely written."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = []
    for status in fs.listStatus(root):
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "log/model_id=model/_SUCCESS")
        if fs.exists(done):
            names.append(status.getPath().getName())
    return checkpoint_rounds(names)


def save_each_round(spark: SparkSession, path: str) -> Callable[[Model, int], None]:
    """A callback that writes the model of every round to its own folder, so a killed job leaves one."""
    def save(model: Model, round_number: int) -> None:
        save_model(model, spark, f"{path}/checkpoint.{round_number}")

    return save


def load_checkpoint(spark: SparkSession, path: str) -> tuple[Model | None, int]:
    """Newest readable model and the round to go on with; an unreadable one falls back to the one before."""
    numbers = stored_rounds(spark, path)[::-1]
    for number in numbers:
        try:
            return load_model(spark, f"{path}/checkpoint.{number}"), number + 1
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "FAILED_READ_FILE" not in str(e) and "CANNOT_READ" not in str(e):
                raise
    if numbers:
        raise RuntimeError(f"none of the checkpoints {numbers} in {path} can be read; training would start over them")
    return None, 0


def resume_fit(df: DataFrame, params: dict, path: str, validation: DataFrame | None = None) -> Model:
    """Trains the rounds still missing up to ``num_round``, saving each one; nothing is trained when none is.

    With ``process_type=update`` the newest saved model is updated and returned; the saved ones stay as they are.
    """
    spark = df.sparkSession
    start, _ = load_checkpoint(spark, path)
    if params.get("process_type") == "update":
        return fit_boosted_trees(df, params, validation, start=start)
    return fit_boosted_trees(df, params, validation, start=start, on_round=save_each_round(spark, path))
