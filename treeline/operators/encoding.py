"""Predictions of each request as response text.

A response is one string, so the rows of one request end up in one cell; requests themselves are bounded by
the size limit of a payload. Whole tables are written with ``write_lines`` instead, one row per line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _per_request(df: DataFrame, value: Column, request_id: str, row: str) -> DataFrame:
    """Values of a request in row order, and its first error when rows carry one."""
    gathered = [F.array_sort(F.collect_list(F.struct(F.col(row).alias("i"), value.alias("v")))).alias("all")]
    if "error" in df.columns:
        gathered.append(F.min("error").alias("error"))
    grouped = df.groupBy(request_id).agg(*gathered)
    return grouped.withColumn("values", F.transform("all", lambda e: e["v"])).drop("all")


def _respond(out: DataFrame, request_id: str, body: Column) -> DataFrame:
    """``request_id, body[, error]``; a request with an error has no body."""
    if "error" not in out.columns:
        return out.select(request_id, body.alias("body"))
    return out.select(request_id, F.when(F.col("error").isNull(), body).alias("body"), "error")


def encode_csv_batch(df: DataFrame, value: str = "prediction", request_id: str = "request_id", row: str = "row_idx") -> DataFrame:
    """One prediction per line, with a final newline; a missing one is ``nan``."""
    out = _per_request(df, F.coalesce(F.col(value).cast("string"), F.lit("nan")), request_id, row)
    return _respond(out, request_id, F.concat(F.array_join("values", "\n"), F.lit("\n")))


def encode_csv_online(df: DataFrame, value: str = "prediction", request_id: str = "request_id", row: str = "row_idx") -> DataFrame:
    """All predictions of a request on one line; a missing one is ``nan``."""
    out = _per_request(df, F.coalesce(F.col(value).cast("string"), F.lit("nan")), request_id, row)
    return _respond(out, request_id, F.array_join("values", ","))


def selected_csv_line(df: DataFrame, keys: Sequence[str], selected: str = "selected") -> Column:
    """One line of requested keys; lists are quoted ``"[a, b]"``, not applicable is ``nan``."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema[selected].dataType.fields}
    parts = []
    for k in keys:
        column = F.col(f"{selected}.{k}")
        text = F.concat(F.lit('"['), F.array_join(column.cast("array<string>"), ", "), F.lit(']"')) if kinds[k] == "array" else column.cast("string")
        parts.append(F.coalesce(text, F.lit("nan")))
    return F.concat_ws(",", *parts)


def encode_selected_csv(
    df: DataFrame, keys: Sequence[str], selected: str = "selected", request_id: str = "request_id", row: str = "row_idx", batch: bool = False
) -> DataFrame:
    out = _per_request(df, selected_csv_line(df, keys, selected), request_id, row)
    body = F.array_join("values", "\n")
    return _respond(out, request_id, F.concat(body, F.lit("\n")) if batch else body)


def encode_json(
    df: DataFrame, selected: str = "selected", request_id: str = "request_id", row: str = "row_idx", nan: str = "null"
) -> DataFrame:
    """``{"predictions": [...]}``; a not applicable key is ``null``, or the literal ``NaN`` when asked."""
    out = _per_request(df, F.col(selected), request_id, row)
    text = F.to_json(F.struct(F.col("values").alias("predictions")), {"ignoreNullFields": "false"})
    if nan == "literal":
        text = F.regexp_replace(text, ":null([,}])", ":NaN$1")
    return _respond(out, request_id, text)


def encode_scores_json(df: DataFrame, value: str = "prediction", request_id: str = "request_id", row: str = "row_idx") -> DataFrame:
    """``{"predictions": [{"score": x}, ...]}``."""
    return encode_json(df.withColumn("__s", F.struct(F.col(value).alias("score"))), "__s", request_id, row)


def encode_jsonlines(df: DataFrame, selected: str = "selected") -> DataFrame:
    """``line``: one JSON object per row, not applicable keys as ``null``."""
    return df.withColumn("line", F.to_json(selected, {"ignoreNullFields": "false"}))


def encode_jsonlines_body(df: DataFrame, selected: str = "selected", request_id: str = "request_id", row: str = "row_idx") -> DataFrame:
    """One JSON object per line, each with a final newline; not applicable keys are ``null``."""
    out = _per_request(df, F.to_json(selected, {"ignoreNullFields": "false"}), request_id, row)
    return _respond(out, request_id, F.concat(F.array_join("values", "\n"), F.lit("\n")))


def encode_records_body(df: DataFrame, record: str, request_id: str = "request_id", row: str = "row_idx") -> DataFrame:
    """The framed records of a request end to end, as bytes."""
    out = _per_request(df, F.hex(record), request_id, row)
    return _respond(out, request_id, F.unhex(F.array_join("values", "")))


def json_to_jsonlines(df: DataFrame, body: str = "body", request_id: str = "request_id") -> DataFrame:
    """``request_id, row_idx, line`` from JSON bodies with a single top key; more keys are an error."""
    keys = F.json_object_keys(body)
    error = F.raise_error(F.lit("JSON response is not compatible for conversion to jsonlines")).cast("string")
    key = F.when(F.size(keys) == 1, keys[0]).otherwise(error)
    entries = F.map_values(F.from_json(body, "map<string, array<string>>"))[0]
    return df.where(key.isNotNull()).select(request_id, F.posexplode(entries).alias("row_idx", "line"))


def write_lines(df: DataFrame, line: str, path: str, order: Sequence[str] = ()) -> None:
    """Text files with one row per line; ``order`` gives a total order over files and lines."""
    out = df.sort(*order) if order else df
    out.select(F.col(line).cast("string").alias("value")).write.mode("overwrite").text(path)


def cv_prediction_lines(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``row_id, line``: label, mean probability, class (or label, mean) with six decimals."""
    columns = [c for c in ("label", "prob", "pred") if c in df.columns]
    text = F.concat_ws(",", *[F.format_string("%f", F.col(c).cast("double")) for c in columns])
    return df.select(row_id, text.alias("line"))


def write_cv_predictions(df: DataFrame, path: str, row_id: str = "row_id") -> None:
    """Headerless CSV of aggregated out-of-fold predictions in row order."""
    write_lines(cv_prediction_lines(df, row_id), "line", path, [row_id])
