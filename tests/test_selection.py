"""Selected outputs and encoders on two fixed predictions."""

import pytest
from pyspark.sql import functions as F

from treeline.operators import encoding as E
from treeline.operators import selection as S
from treeline.sources import recordio


def binary(spark, values=(0.6, 0.1)):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "request_id int, row_idx int, prediction double")


@pytest.mark.parametrize(
    "fn,objective,value,want",
    [
        (S.select_predicted_label, "binary:hinge", 0.0, 0.0),
        (S.select_predicted_label, "binary:logistic", 0.6, 1),
        (S.select_predicted_label, "binary:logitraw", -7.6, 0),
        (S.select_predicted_label, "multi:softprob", [0.1, 0.5, 0.4], 1),
        (S.select_predicted_label, "multi:softmax", 2.0, 2.0),
        (S.select_predicted_label, "reg:squarederror", 2.0, None),
        (S.select_probability, "multi:softprob", [0.1, 0.5, 0.4], 0.5),
        (S.select_probability, "binary:hinge", 1.0, None),
        (S.select_probabilities, "binary:logistic", 0.6, [0.4, 0.6]),
        (S.select_raw_score, "binary:logitraw", -7.6, -7.6),
        (S.select_raw_scores, "binary:hinge", 1.0, [0.0, 1.0]),
        (S.select_raw_scores, "multi:softprob", [0.1, 0.5, 0.4], [0.1, 0.5, 0.4]),
        (S.select_predicted_score, "reg:gamma", 4.5, 4.5),
    ],
)
def test_one_key(spark, fn, objective, value, want):
    kind = "array<double>" if isinstance(value, list) else "double"
    got = spark.createDataFrame([(value,)], f"v {kind}").select(fn(objective, F.col("v")).alias("o")).first()["o"]
    assert got == (pytest.approx(want) if want is not None else None)


def test_key_lists(spark):
    assert S.parse_keys("Predicted_Label, probabilities") == ["predicted_label", "probabilities"]
    assert S.split_keys(["predicted_label", "predicted_score"], "binary:logistic") == (["predicted_label"], ["predicted_score"])
    with pytest.raises(ValueError):
        S.split_keys(["predicted_label"], "rank:pairwise")


def test_encoders(spark):
    keys = ["predicted_label", "probabilities"]
    df = S.select_predictions(binary(spark), keys, "binary:logistic")
    assert E.encode_selected_csv(df, keys).first()["body"] == '1,"[0.4, 0.6]"\n0,"[0.9, 0.1]"'
    assert E.encode_json(df).first()["body"] == '{"predictions":[{"predicted_label":1,"probabilities":[0.4,0.6]},{"predicted_label":0,"probabilities":[0.9,0.1]}]}'
    lines = [r["line"] for r in E.json_to_jsonlines(E.encode_json(df)).sort("row_idx").collect()]
    assert lines == ['{"predicted_label":1,"probabilities":[0.4,0.6]}', '{"predicted_label":0,"probabilities":[0.9,0.1]}']
    assert E.encode_scores_json(binary(spark)).first()["body"] == '{"predictions":[{"score":0.6},{"score":0.1}]}'


def test_not_applicable_is_null_or_literal(spark):
    df = S.select_predictions(binary(spark, (0.6,)), ["predicted_label", "predicted_score"], "binary:logistic")
    assert E.encode_json(df).first()["body"] == '{"predictions":[{"predicted_label":1,"predicted_score":null}]}'
    assert E.encode_json(df, nan="literal").first()["body"].endswith('"predicted_score":NaN}]}')


def test_two_top_keys_are_an_error(spark):
    df = spark.createDataFrame([(0, '{"predictions": [], "metadata": []}')], "request_id int, body string")
    with pytest.raises(Exception, match="not compatible"):
        E.json_to_jsonlines(df).collect()


def test_recordio_selected(spark):
    df = S.select_predictions(binary(spark), ["predicted_label", "probabilities"], "binary:logistic").select("row_idx", "selected.*")
    rows = recordio.encode_recordio(df, ["predicted_label", "probabilities"]).sort("row_idx").collect()
    for row, label, probs in zip(rows, (1.0, 0.0), ([0.4, 0.6], [0.9, 0.1])):
        (body,) = recordio.frames(bytes(row["record"]))
        found = dict(recordio._entry(value) for _, value in recordio._fields(body))
        assert found["predicted_label"][0] == [label]
        assert found["probabilities"][0] == pytest.approx(probs, rel=1e-6)
