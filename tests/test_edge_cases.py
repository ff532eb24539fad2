"""Rows that metrics, readers, encoders and trainers must not lose or misread without a word."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import checks
from treeline.operators.crossval import attach_predictions
from treeline.operators.encoding import encode_csv_batch
from treeline.operators.evaluation import evaluate_rows
from treeline.plans.boosting import fit_boosted_trees
from treeline.plans import linear
from treeline.plans.linear import fit_linear, predict_linear
from treeline.plans.refresh import refresh_trees
from treeline.plans.resume import load_checkpoint
from treeline.plans.scoring import predict_ensemble, predict_trees
from treeline.sources.payloads import payload_rows_libsvm


def metric(spark, name, rows, **options):
    frame = spark.createDataFrame(rows, "label double, pred double, label_lower double, label_upper double")
    return evaluate_rows(frame, [name], **options).first()["value"]


def test_open_limits_count(spark):
    rows = [(0.0, 5.0, 1.0, None), (0.0, 5.0, None, 4.0), (0.0, 2.0, 1.0, 3.0), (0.0, 0.5, 1.0, None)]
    assert metric(spark, "interval-regression-accuracy", rows) == 0.5


def test_undefined_terms_surface(spark):
    assert math.isnan(metric(spark, "rmsle", [(1.0, -2.0, None, None), (1.0, 1.0, None, None)]))
    assert math.isnan(metric(spark, "gamma-nloglik", [(1.0, -2.0, None, None), (1.0, 1.0, None, None)]))
    assert metric(spark, "mape", [(0.0, 1.0, None, None), (2.0, 1.0, None, None)]) == math.inf
    assert metric(spark, "mape", [(4.0, 1.0, None, None), (2.0, 1.0, None, None)]) == pytest.approx(0.625)


def test_rows_without_prediction_stay(spark):
    got = attach_predictions(spark.range(3).withColumnRenamed("id", "row_id"), spark.createDataFrame([(1, 0.5)], "row_id long, pred double"))
    assert sorted((r.row_id, r.pred) for r in got.collect()) == [(0, None), (1, 0.5), (2, None)]


def test_missing_predictions_keep_their_line(spark):
    frame = spark.createDataFrame([("a", 0, 1.5), ("a", 1, None), ("a", 2, 2.5)], "request_id string, row_idx int, prediction double")
    assert encode_csv_batch(frame).first()["body"] == "1.5\nnan\n2.5\n"


def test_a_bad_token_harms_its_row_only(spark):
    frame = spark.createDataFrame([("a", "0:1 5:x\n0:2 5:3"), ("b", "0:7")], "request_id string, body string")
    got = {(r.request_id, r.row_idx): r.features for r in payload_rows_libsvm(frame).collect()}
    assert got == {("a", 0): None, ("a", 1): {0: 2.0, 5: 3.0}, ("b", 0): {0: 7.0}}


KIND = "label double, weight double, features array<double>"


def linear_rows(spark, n=240, width=3, parts=4):
    r = np.random.default_rng(3)
    x, w = r.normal(size=(n, width)), r.integers(1, 4, n).astype(float)
    y = np.round(np.exp(0.4 * x[:, 0] - 0.3 * x[:, -1] + 1.0) + r.random(n), 3)
    return x, y, w, spark.createDataFrame([(float(a), float(b), c.tolist()) for a, b, c in zip(y, w, x)], KIND).repartition(parts)


def test_linear_booster_equals_closed_form_ridge(spark, monkeypatch):
    x, y, w, frame = linear_rows(spark, width=5)
    design = np.hstack([np.ones((len(y), 1)), x])
    for bias in (0.0, 0.5):
        penalty = np.diag([bias] + [0.2] * 5) * w.sum()
        want = np.linalg.solve(design.T @ (design * w[:, None]) + penalty, design.T @ (w * (y - 0.5)))
        params = {"num_round": 200, "eta": 1.0, "lambda": 0.2, "lambda_bias": bias}
        model = fit_linear(frame, params)
        assert [model.bias[0], *model.weights[0]] == pytest.approx(want.tolist(), abs=1e-9)
    monkeypatch.setattr(linear, "BLOCK", 2)
    model = fit_linear(frame, {**params, "num_round": 12})
    assert [model.bias[0], *model.weights[0]] == pytest.approx(want.tolist(), abs=1e-3)


@pytest.mark.parametrize("objective", ["count:poisson", "reg:gamma", "reg:squarederror"])
def test_linear_round_equals_one_pass_per_coordinate(spark, objective):
    x, y, w, frame = linear_rows(spark)
    model = fit_linear(frame, {"objective": objective, "num_round": 2, "eta": 0.7, "lambda": 0.05, "alpha": 0.01, "lambda_bias": 0.1, "max_delta_step": 0.2})
    design, value, base = np.hstack([np.ones((len(y), 1)), x]), np.zeros(4), 0.5 if objective == "reg:squarederror" else math.log(0.5)
    for _ in range(2):
        m = base + design @ value
        g, h = {"count:poisson": (np.exp(m) - y, np.exp(m + 0.2)), "reg:gamma": (1 - y * np.exp(-m), y * np.exp(-m)), "reg:squarederror": (m - y, np.ones(len(y)))}[objective]
        g, h = g * w, h * w
        for i in range(4):
            l2, l1 = (0.1 if i == 0 else 0.05) * w.sum(), (0.0 if i == 0 else 0.01) * w.sum()
            G, H = (g * design[:, i]).sum(), (h * design[:, i] ** 2).sum()
            pull = H * value[i] - G
            step = 0.7 * (math.copysign(max(abs(pull) - l1, 0.0), pull) / (H + l2) - value[i])
            value[i] += step
            g = g + h * design[:, i] * step
    assert [model.bias[0], *model.weights[0]] == pytest.approx(value.tolist(), abs=1e-9)


def test_linear_booster_logs_and_classes(spark):
    _, y, _, frame = linear_rows(spark)
    classes = frame.withColumn("label", F.least(F.floor("label") - F.lit(1), F.lit(2)).cast("double"))
    classes = classes.withColumn("label", F.greatest("label", F.lit(0.0)))
    model = fit_linear(classes, {"objective": "multi:softprob", "num_class": 3, "num_round": 4, "eval_metric": "mlogloss"}, validation=classes)
    loss = [x["value"] for x in model.log if x["dataset"] == "train"]
    assert len(model.log) == 8 and loss == sorted(loss, reverse=True) and loss == pytest.approx([x["value"] for x in model.log if x["dataset"] == "validation"])
    assert all(sum(r.prediction) == pytest.approx(1.0) for r in predict_linear(classes, model).collect())
    assert not spark.sparkContext._jsc.getPersistentRDDs()


@pytest.mark.parametrize("rows", [[], [(1.0, 1.0, [1.0]), (1.0, 1.0, [1.0, 2.0])], [(None, 1.0, [1.0])], [(1.0, 1.0, None)]])
def test_linear_booster_refuses_unfit_rows(spark, rows):
    with pytest.raises(ValueError):
        fit_linear(spark.createDataFrame(rows, KIND), {"num_round": 1})


def test_linear_booster_takes_missing_values_as_zero(spark):
    model = fit_linear(spark.createDataFrame([(1.0, 1.0, [None, 1.0]), (2.0, 1.0, [1.0, float("nan")])], KIND), {"num_round": 2})
    assert all(map(math.isfinite, model.weights[0]))
    with pytest.raises(ValueError):
        fit_linear(spark.createDataFrame([(1.0, 1.0, [1.0])], KIND), {"objective": "rank:pairwise", "num_round": 1})


def test_duplicate_rows(spark):
    kind = "a long, b string"
    train = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], kind)
    held = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, None), (None, None)], kind)
    assert sorted((r.a, r.b or "", r.n) for r in checks.duplicate_rows(train, held).collect()) == [(1, "x", 2), (2, "", 1)]


def test_refresh_knows_parallel_trees_and_l1(spark):
    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 7 + F.col("id") % 3).cast("double").alias("label"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double")).alias("features"))
    model = fit_boosted_trees(rows, {"num_round": 2, "max_depth": 2, "max_bin": 16, "num_parallel_tree": 3, "alpha": 1.0, "base_score": 0.0})
    fresh = refresh_trees(rows, model)
    for old, new in zip((t for r in model.trees for t in r), (t for r in fresh.trees for t in r)):
        assert [v for v, f in zip(new.value, new.feature) if f < 0] == pytest.approx([v for v, f in zip(old.value, old.feature) if f < 0], abs=1e-6)
    together = predict_ensemble(rows, [model, fresh]).join(predict_trees(rows.select("row_id", "features"), model, output="one"), "row_id")
    assert all(r.prediction == pytest.approx(r.one, abs=1e-6) for r in together.collect())
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_unreadable_checkpoints_raise(spark, tmp_path):
    assert load_checkpoint(spark, str(tmp_path / "none"))[0] is None
    for n in (1, 2):
        done = tmp_path / f"checkpoint.{n}" / "log" / "model_id=model"
        done.mkdir(parents=True)
        (done / "_SUCCESS").write_text("")
    with pytest.raises(Exception):
        load_checkpoint(spark, str(tmp_path))
