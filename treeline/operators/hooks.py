"""Scoring with user functions: model_fn, input_fn, predict_fn, output_fn, or one transform_fn."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def parse_csv_body(body: str, content_type: str):
    """Default input function: rows of numbers, an empty field is NaN."""
    return [[float(v) if v else float("nan") for v in line.split(",")] for line in body.strip().split("\n")]


def predict_with_model(data, model):
    """Default prediction function: the model is called on the data."""
    return model(data)


def join_lines(prediction, accept: str) -> str:
    """Default output function: one prediction per line."""
    return "\n".join(str(p) for p in prediction)


def score_with_user_hooks(
    requests: DataFrame,
    model_fn: Callable,
    model_dir: str = "",
    input_fn: Callable | None = None,
    predict_fn: Callable | None = None,
    output_fn: Callable | None = None,
    transform_fn: Callable | None = None,
    accept: str = "text/csv",
) -> DataFrame:
    """``request_id, response, error`` from ``request_id, body, content_type``; the model is loaded once per task.

    ``transform_fn(model, body, content_type, accept)`` replaces the other three and cannot be mixed with them.
    """
    if transform_fn and (input_fn or predict_fn or output_fn):
        raise ValueError("cannot use transform_fn together with input_fn, predict_fn or output_fn")
    read, predict, write = input_fn or parse_csv_body, predict_fn or predict_with_model, output_fn or join_lines

    def answer(model, body, content_type):
        if transform_fn:
            return transform_fn(model, body, content_type, accept)
        return write(predict(read(body, content_type), model), accept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_fn(model_dir)
        for batch in batches:
            rows = []
            for rid, body, kind in zip(batch["request_id"], batch["body"], batch["content_type"]):
                try:
                    rows.append((rid, answer(model, body, kind), None))
                except Exception as e:
                    rows.append((rid, None, str(e)))
            yield pd.DataFrame(rows, columns=["request_id", "response", "error"])

    kind = dict(requests.dtypes)["request_id"]
    if "content_type" not in requests.columns:
        requests = requests.withColumn("content_type", F.lit("text/csv"))
    return requests.select("request_id", "body", "content_type").mapInPandas(run, f"request_id {kind}, response string, error string")
