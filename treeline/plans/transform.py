"""Request tables to responses: decode, predict, select, encode. Works on batches and on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from treeline.operators.encoding import encode_csv_batch, encode_json, encode_jsonlines_body, encode_records_body, encode_selected_csv
from treeline.operators.selection import select_predictions
from treeline.plans.model import Model
from treeline.plans.scoring import predict_ensemble, predict_trees
from treeline.sources.payloads import payload_rows_csv, payload_rows_libsvm, payload_rows_recordio
from treeline.sources.recordio import encode_recordio, with_features
from treeline.sources.text import dense_features

ACCEPTS = ("csv", "json", "jsonlines", "recordio-protobuf")


def decode_requests(requests: DataFrame, content_type: str, width: int, request_id: str = "request_id", body: str = "body") -> DataFrame:
    """``request_id, row_idx, features, error``; every request has at least one row.

    A row has an error when its body is empty, a field is no number, the record is broken, or its width does not fit
    the model: LIBSVM may have one column more, others as many or one less.
    """
    if content_type != "recordio-protobuf":
        # a null body has no line that could carry its error
        requests = requests.withColumn(body, F.coalesce(body, F.lit("")))
    if content_type == "csv":
        rows = payload_rows_csv(requests, request_id, body)
        n = F.size("features")
        empty = (n == 1) & F.get("features", F.lit(0)).isNull()
        fault = F.when(empty, F.lit("empty row"))
    elif content_type == "libsvm":
        rows = payload_rows_libsvm(requests, request_id, body)
        bad = F.col("features").isNull()
        n = F.when(~bad, F.coalesce(F.array_max(F.map_keys("features")) + 1, F.lit(0)))
        rows = rows.select("*", F.when(bad, F.lit("not index:value")).when(F.size("features") == 0, F.lit("empty row")).alias("error"), n.alias("__n"))
        rows, n, fault = dense_features(rows, width), F.col("__n"), F.lit(None).cast("string")
    elif content_type == "recordio-protobuf":
        rows = with_features(payload_rows_recordio(requests, request_id, body))
        n, fault = F.col("width"), F.lit(None).cast("string")
    else:
        raise ValueError(f"content type {content_type} is not supported")
    fits = n <= width + 1 if content_type == "libsvm" else n.isin(width, width - 1)
    wrong = F.when(~fits, F.concat(n.cast("string"), F.lit(f" features for a model of {width}")))
    return rows.select(request_id, "row_idx", "features", F.coalesce("error", fault, wrong).alias("error"))


def score_rows(
    requests: DataFrame, model: Model | Sequence[Model], content_type: str = "csv", keys: Sequence[str] | None = None,
    request_id: str = "request_id", body: str = "body",
) -> DataFrame:
    """``request_id, row_idx, prediction[, selected], error``, one row per record; stateless, so it also runs on a stream.

    Several models answer together, as ``predict_ensemble`` joins them; all must have the same number of features.
    """
    members = [model] if isinstance(model, Model) else list(model)
    widths = {m.n_features for m in members}
    if len(widths) != 1:
        raise ValueError(f"requests need models of one width, not {sorted(widths)}")
    rows = decode_requests(requests, content_type, widths.pop(), request_id, body)
    scored = predict_trees(rows, members[0]) if len(members) == 1 else predict_ensemble(rows, members)
    scored = scored.withColumn("prediction", F.when(F.col("error").isNull(), F.col("prediction")))
    if keys:
        scored = select_predictions(scored, keys, members[0].objective, members[0].params.get("num_class"))
    return scored


def batch_transform(
    requests: DataFrame, model: Model | Sequence[Model], content_type: str = "csv", accept: str = "csv", keys: Sequence[str] | None = None,
    request_id: str = "request_id", body: str = "body",
) -> DataFrame:
    """``request_id, body, error``: the response per request; a request with a bad row has an error and no body.

    ``accept`` is csv, json, jsonlines or recordio-protobuf (bytes). Without ``keys`` an answer holds the predictions
    alone, under the key ``score`` where the form has keys.
    """
    if accept not in ACCEPTS:
        raise ValueError(f"accept type {accept} is not supported, only {', '.join(ACCEPTS)}")
    scored = score_rows(requests, model, content_type, keys, request_id, body)
    if accept == "csv":
        if keys:
            return encode_selected_csv(scored, keys, request_id=request_id, batch=True)
        return encode_csv_batch(scored, request_id=request_id)
    if not keys:
        keys, scored = ["score"], scored.withColumn("selected", F.struct(F.col("prediction").alias("score")))
    if accept == "json":
        return encode_json(scored, request_id=request_id)
    if accept == "jsonlines":
        return encode_jsonlines_body(scored, request_id=request_id)
    framed = encode_recordio(scored.select(request_id, "row_idx", "error", "selected.*"), keys)
    return encode_records_body(framed, "record", request_id)
