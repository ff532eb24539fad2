"""Invariants of trained models, parameters, folds, stopping, resuming and updating."""

import copy
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from treeline.operators import crossval as V
from treeline.operators import histograms as H
from treeline.operators import ordering, pairs, sketches
from treeline.operators.folds import kfold_assign, stratified_kfold_assign
from treeline.operators.hooks import score_with_user_hooks
from treeline.plans import boosting, scoring
from treeline.plans.boosting import fit_boosted_trees
from treeline.plans.kfold import fit_kfold
from treeline.plans.model import load_model, model_ids, save_model
from treeline.plans.parameters import DEFAULTS, resolve_parameters
from treeline.plans.refresh import prune_trees, refresh_trees
from treeline.plans.resume import checkpoint_rounds, load_checkpoint, resume_fit, stored_rounds
from treeline.plans.scoring import predict_contribs, predict_trees
from treeline.session import shared_dir


@pytest.fixture(scope="module")
def rows(spark):
    """A step in feature 0, a slope in feature 1, noise in feature 2, some values missing."""
    df = spark.range(800).select(
        F.col("id").alias("row_id"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 37 / 10.0).alias("b"),
        (F.col("id") * 7919 % 101).cast("double").alias("c"),
    )
    label = F.when(F.col("a") > 11, 3.0).otherwise(0.0) + F.col("b")
    missing = F.when(F.col("row_id") % 13 != 0, F.col("a"))
    return df.select("row_id", label.alias("label"), F.array(missing, "b", "c").alias("features")).cache()


def losses(model, data_name="train"):
    return [r[4] for r in model.log if r[2] == data_name]


def test_loss_falls_and_scoring_agrees_with_the_log(spark, rows):
    model = fit_boosted_trees(rows, {"num_round": 7, "max_depth": 3, "max_bin": 32})
    assert losses(model) == sorted(losses(model), reverse=True)
    scored = predict_trees(rows, model)
    rmse = scored.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
    assert rmse == pytest.approx(losses(model)[-1])
    both = predict_contribs(predict_trees(scored, model, output="m", margin=True), model)
    total = F.aggregate("contribs", F.lit(0.0), lambda x, y: x + y)
    assert both.where(F.abs(total - F.col("m")) > 1e-9).count() == 0


def test_partitioning_and_subtraction_do_not_change_the_model(spark, rows, monkeypatch):
    params = {"num_round": 2, "max_depth": 3, "max_bin": 32, "subsample": 0.8, "seed": 3}
    one = fit_boosted_trees(rows.repartition(1), params).node_rows()
    many = fit_boosted_trees(rows.repartition(8), params).node_rows()
    assert one == many
    monkeypatch.setattr(boosting, "SUBTRACT_CELLS", 0)
    less = fit_boosted_trees(rows, params).node_rows()
    assert [r[:5] for r in less] == [r[:5] for r in one]
    assert [r[12] for r in less] == pytest.approx([r[12] for r in one])
    loss_guided = {**params, "grow_policy": "lossguide", "max_leaves": 5}
    assert fit_boosted_trees(rows, loss_guided).node_rows()


def test_broadcast_scoring_equals_literal_scoring(spark, rows, monkeypatch):
    model = fit_boosted_trees(rows, {"num_round": 3, "max_depth": 3, "max_bin": 32})
    literal = predict_trees(rows, model).select("row_id", F.col("prediction").alias("a"))
    monkeypatch.setattr(scoring, "LITERAL_NODES", 0)
    monkeypatch.setattr(scoring, "BROADCAST_NODES", 10)
    shared = predict_trees(rows, model).select("row_id", F.col("prediction").alias("b"))
    assert literal.join(shared, "row_id").where("a <=> b").count() == rows.count()


def test_histogram_totals(spark, rows):
    g = rows.select(F.lit(0).alias("tree"), F.lit(0).alias("node"), F.col("label").alias("g"), F.lit(1.0).alias("h"), "features")
    binned = H.bin_features(g, [[5.0, 10.0], [1.0], []])
    hist = H.node_histogram(binned)
    want = rows.agg(F.sum("label")).first()[0]
    for r in hist.groupBy("feature").agg((F.sum("sg") / 2**20).alias("g"), F.sum("n").alias("n")).collect():
        assert r["g"] == pytest.approx(want, abs=1e-2) and r["n"] == 800


@pytest.mark.parametrize("top", [5, 60_000])
def test_histogram_equals_exploded_rows(spark, top, monkeypatch):
    """Few cells are counted in place, many by sorting; small chunks and a small store of cells change nothing."""
    df = spark.range(3000).repartition(3).select(
        (F.col("id") % 2).cast("int").alias("tree"), (F.col("id") % 7).cast("int").alias("node"),
        F.when(F.col("id") % 11 != 0, F.sin("id") * 1e3).alias("g"), (F.col("id") % 5 / 3).alias("h"),
        F.array(*[(F.hash("id", F.lit(i)) % top + top).cast("int") for i in range(3)]).alias("bins"),
    )
    monkeypatch.setattr(H, "CHUNK_ROWS", 300)
    monkeypatch.setattr(H, "HELD_CELLS", 500)
    got = H.node_histogram(df, bits=40)
    long = df.select("tree", "node", *[F.coalesce(H.fixed_point(F.col(c), 40), F.lit(0)).alias(c) for c in "gh"], F.posexplode("bins").alias("feature", "bin"))
    want = long.groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("sg"), F.sum("h").alias("sh"), F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert H.node_histogram(df.limit(0)).count() == 0


def test_histogram_sums_keep_every_bit():
    values = np.array([2**61 + 1, 2**60 + 3, -(2**61) + 5, -7])
    assert H._exact_sums(np.array([0, 0, 1, 0]), values, 2).tolist() == [2**61 + 2**60 - 3, -(2**61) + 5]


def test_ragged_and_missing_features_get_bin_zero(spark):
    nan = float("nan")
    df = spark.createDataFrame([([0.5, 2.0],), ([1.0],), (None,), ([None, nan, 7.0],), ([float("-inf"), float("inf"), 0.0],)], "features array<double>")
    got = [tuple(r["bins"]) for r in H.bin_features(df.coalesce(1), [[1.0], [0.0, 2.0]]).collect()]
    assert got == [(1, 3), (2, 0), (0, 0), (0, 0), (1, 3)]


def test_stored_nodes_change_no_tree(spark, rows, monkeypatch):
    before = set(spark.sparkContext._jsc.getPersistentRDDs().keys())
    for params in ({"max_depth": 4}, {"max_depth": 4, "grow_policy": "lossguide", "max_leaves": 6}):
        params = {"num_round": 1, "max_bin": 32, "subsample": 0.9, "num_parallel_tree": 2, **params}
        monkeypatch.setattr(boosting, "KEPT_STEPS", 100)
        want = fit_boosted_trees(rows, params)
        monkeypatch.setattr(boosting, "KEPT_STEPS", 2)
        got = fit_boosted_trees(rows, params)
        assert got.node_rows() == want.node_rows() and got.log == want.log
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keys()) <= before
    assert not [f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("nodes-")]


def test_a_model_to_save_on_termination_needs_a_place(spark, rows):
    params = {"num_round": 1, "max_depth": 1, "save_model_on_termination": "true"}
    with pytest.raises(ValueError, match="resume_fit"):
        fit_boosted_trees(rows, params)
    assert fit_boosted_trees(rows, params, on_round=lambda model, last: None).trees


def test_max_bin_has_a_limit(spark, rows):
    with pytest.raises(ValueError, match="max_bin"):
        fit_boosted_trees(rows, {"num_round": 1, "max_bin": 70_000})


def test_monotone_and_interaction(spark, rows):
    params = {"num_round": 3, "max_depth": 3, "max_bin": 16, "tree_method": "hist", "monotone_constraints": "(0,-1,0)"}
    model = fit_boosted_trees(rows, params)
    grid = spark.range(38).select(F.array(F.lit(5.0), F.col("id") / 10.0, F.lit(50.0)).alias("features"), "id")
    curve = [r["prediction"] for r in predict_trees(grid, model).sort("id").collect()]
    assert all(x >= y - 1e-12 for x, y in zip(curve, curve[1:]))
    model = fit_boosted_trees(rows, {**params, "monotone_constraints": "(0,0,0)", "interaction_constraints": "[[1],[2]]"} | {"num_round": 2})
    for trees in model.trees:
        for t in trees:
            assert all(len(path) <= 1 for path in t.path)


def test_absolute_error_leaves_are_medians(spark):
    df = spark.createDataFrame([(y, [x]) for x, y in [(0.0, 1.0), (0.0, 1.0), (0.0, 9.0), (1.0, 5.0), (1.0, 5.0), (1.0, 6.0)]], "label double, features array<double>")
    model = fit_boosted_trees(df, {"objective": "reg:absoluteerror", "num_round": 1, "max_depth": 1, "eta": 1.0, "base_score": 4.0, "min_child_weight": 0})
    got = sorted({round(r["prediction"], 6) for r in predict_trees(df, model).collect()})
    assert got == [1.0, 5.0]


@pytest.mark.parametrize("objective,extra", [
    ("binary:logistic", {}), ("binary:hinge", {}), ("multi:softprob", {"num_class": 3}), ("multi:softmax", {"num_class": 3}),
    ("count:poisson", {}), ("rank:pairwise", {}), ("survival:cox", {}),
])
def test_objectives_improve(spark, rows, objective, extra):
    y = F.when(F.col("label") > 3, 1.0).otherwise(0.0)
    if extra:
        y = y + F.when(F.col("label") > 5, 1.0).otherwise(0.0)
    if objective == "survival:cox":
        y = F.when(F.col("row_id") % 5 == 0, -F.col("label") - 1).otherwise(F.col("label") + 1)
    df = rows.withColumn("label", y).withColumn("group_id", F.when(F.col("row_id") % 3 == 0, 0).otherwise(F.col("row_id") % 9))
    model = fit_boosted_trees(df, {"objective": objective, "num_round": 3, "max_depth": 2, "max_bin": 16, **extra})
    first, last = losses(model)[0], losses(model)[-1]
    assert last >= first if objective.startswith("rank:") else last <= first


def test_aft_gradients_are_the_slope_of_the_loss(spark):
    from treeline.operators.evaluation import aft_term
    from treeline.operators.gradients import gradient_pairs

    rows = [(2.0, 2.0, 0.3), (2.0, 5.0, 0.3), (2.0, None, 0.9), (0.0, 3.0, 0.4)]
    for dist in ("normal", "logistic", "extreme"):
        df = spark.createDataFrame([(1.0, lo, up, m) for lo, up, m in rows], "label double, label_lower double, label_upper double, m_0 double")
        df = gradient_pairs(df, "survival:aft", {**DEFAULTS, "aft_loss_distribution": dist}, weight=None)
        term = lambda d: aft_term(F.col("label_lower"), F.col("label_upper"), F.exp(F.col("m_0") + d), dist, 1.0)
        for r in df.select("g_0", "h_0", ((term(1e-3) - term(-1e-3)) / 2e-3).alias("slope")).collect():
            assert r["g_0"] == pytest.approx(r["slope"], abs=2e-4) and r["h_0"] > 0


def test_early_stopping_uses_the_best_round(spark, rows):
    flat = rows.withColumn("label", F.rand(5))
    train, held = flat.randomSplit([0.5, 0.5], seed=2)
    model = fit_boosted_trees(train, {"num_round": 8, "max_depth": 4, "max_bin": 16, "early_stopping_rounds": 2, "eta": 1.0, "eval_metric": "mae,rmse"}, validation=held)
    scores = [r[4] for r in model.log if r[2:4] == ("validation", "rmse")]
    assert model.best_round == scores.index(min(scores)) and len(scores) <= 8
    assert model.used_rounds == model.best_round + 1


def test_metric_lists():
    from treeline.operators.confusion import metric_names

    assert metric_names("validation:f1", ["rmse", "auc"]) == ["auc", "f1", "rmse"]
    assert metric_names(None, ["rmse", "auc"]) == ["rmse", "auc"] and metric_names("validation:f1,accuracy", None) == ["f1", "accuracy"]


def test_labels_outside_the_domain_are_an_error(spark, rows):
    with pytest.raises(ValueError, match="logistic"):
        fit_boosted_trees(rows, {"objective": "binary:logistic", "num_round": 1})


def test_dart_scoring_agrees_with_the_log(spark, rows):
    model = fit_boosted_trees(rows, {"booster": "dart", "rate_drop": 0.5, "one_drop": 1, "num_round": 4, "max_depth": 2, "max_bin": 16})
    rmse = predict_trees(rows, model).agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
    assert rmse == pytest.approx(losses(model)[-1]) and any(t.scale != 1.0 for r in model.trees for t in r)


def test_save_load_resume(spark, rows, tmp_path):
    params = {"num_round": 2, "max_depth": 2, "max_bin": 16}
    path = str(tmp_path / "rounds")
    resume_fit(rows, params, path)
    assert stored_rounds(spark, path) == [0, 1]
    resumed = resume_fit(rows, {**params, "num_round": 4}, path)
    straight = fit_boosted_trees(rows, {**params, "num_round": 4})
    assert [r[12] for r in resumed.node_rows()] == pytest.approx([r[12] for r in straight.node_rows()])
    model, following = load_checkpoint(spark, path)
    assert following == 4 and len(resume_fit(rows, params, path).trees) == 4
    save_model(model, spark, str(tmp_path / "m"), "model-1")
    save_model(model, spark, str(tmp_path / "m"), "model-0")
    assert model_ids(spark, str(tmp_path / "m")) == ["model-0", "model-1"]
    assert load_model(spark, str(tmp_path / "m"), "model-1").node_rows() == model.node_rows()


def test_checkpoint_names():
    assert checkpoint_rounds(["checkpoint.100", "checkpoint.989", "checkpoint.101", "checkpoint.99", "other.7"]) == [99, 100, 101, 989]


def test_refresh_on_the_same_rows_keeps_the_model_and_prune_cuts(spark, rows):
    model = fit_boosted_trees(rows, {"num_round": 2, "max_depth": 2, "max_bin": 16, "base_score": 9.0})
    fresh = refresh_trees(rows, model)
    assert [r[12] for r in fresh.node_rows() if r[9] is not None] == pytest.approx([r[12] for r in model.node_rows() if r[9] is not None], abs=1e-6)
    pruned = prune_trees(copy.deepcopy(model), 1e12)
    assert all(t.feature[0] == -1 for r in pruned.trees for t in r)


UPDATE = {"num_round": 2, "max_depth": 2, "max_bin": 16, "process_type": "update"}


def test_update_refreshes_and_prunes_the_given_trees(spark, rows, tmp_path):
    grown = {k: v for k, v in UPDATE.items() if k != "process_type"}
    start = resume_fit(rows, grown, str(tmp_path / "m"))
    other = rows.withColumn("label", F.col("label") * 2 + 1)
    fresh = fit_boosted_trees(other, {**UPDATE, "updater": "refresh"}, start=start, watch={"half": other.where("row_id < 400")})
    assert fresh.node_rows() == refresh_trees(other, start, DEFAULTS).node_rows() != start.node_rows()
    rmse = predict_trees(other, fresh).agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
    assert losses(fresh)[-1] == pytest.approx(rmse) and len(losses(fresh)) == len(losses(fresh, "half")) == 2
    assert resume_fit(other, {**UPDATE, "updater": "refresh"}, str(tmp_path / "m")).node_rows() == fresh.node_rows()
    assert load_checkpoint(spark, str(tmp_path / "m"))[0].node_rows() == start.node_rows()
    gains = sorted(g for r in start.trees for t in r for f, g in zip(t.feature, t.gain) if f >= 0)
    gamma = (gains[0] + gains[1]) / 2  # between two gains: one split falls
    pruned = fit_boosted_trees(rows, {**UPDATE, "updater": "prune", "gamma": gamma}, start=start)
    assert pruned.node_rows() == prune_trees(start, gamma).node_rows()
    assert sum(f >= 0 for r in pruned.trees for t in r for f in t.feature) == len(gains) - 1
    both = fit_boosted_trees(other, {**UPDATE, "updater": "refresh,prune", "gamma": 1e12}, start=start)
    assert all(t.feature[0] == -1 for r in both.trees for t in r)
    # the second round sees the pruned first one: two steps of the same root value
    total = other.agg(F.sum(F.col("label") - 0.5)).first()[0]
    first = total / 801 * 0.3
    assert [t.value[0] for r in both.trees for t in r] == pytest.approx([first, (total - 800 * first) / 801 * 0.3], rel=1e-6)


def test_update_rejects_what_it_cannot_do(spark, rows):
    start = fit_boosted_trees(rows, {"num_round": 1, "max_depth": 1, "max_bin": 8})
    for more, given in (({"updater": "refresh"}, None), ({}, start), ({"updater": "prune", "num_round": 2}, start), ({"updater": "prune", "objective": "reg:gamma"}, start)):
        with pytest.raises(ValueError):
            fit_boosted_trees(rows.where("label > 0"), {"num_round": 1, "process_type": "update", **more}, start=given)


def test_refresh_keeps_scaled_positive_weights_and_gains_with_l1(spark, rows):
    binary = rows.withColumn("label", (F.col("label") > 2).cast("double"))
    model = fit_boosted_trees(binary, {"objective": "binary:logistic", "num_round": 1, "max_depth": 2, "max_bin": 16, "scale_pos_weight": 3.0, "alpha": 2.0})
    fresh = refresh_trees(binary, model)
    for name in ("value", "gain"):
        assert getattr(fresh.trees[0][0], name) == pytest.approx(getattr(model.trees[0][0], name), rel=1e-3, abs=1e-5)


def test_kfold_counts(spark, rows):
    out = fit_kfold(rows, {"num_round": 1, "max_depth": 1, "max_bin": 8, "_kfold": 2, "_num_cv_round": 2})
    assert len(out.models) == 4 and out.predictions.count() == 1600
    V.check_complete(rows, out.predictions, 2)
    assert {r[2] for r in out.log} == {"train", "held_out"}


@pytest.mark.parametrize("per", [10**9, 50])
def test_fold_sizes(spark, rows, monkeypatch, per):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", per)
    df = rows.select("row_id", (F.col("row_id") % 7 == 0).cast("int").alias("y"))
    out = kfold_assign(df, "row_id", 3, repeats=2, seed=1)
    sizes = [r["n"] for r in out.groupBy("repeat", "fold").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1600 and max(sizes) - min(sizes) <= 1
    by_class = stratified_kfold_assign(df, "row_id", "y", 3).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in by_class if r["y"] == y]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("per", [10**9, 50])
def test_pairs_of_a_hot_group(spark, rows, monkeypatch, per):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", per)
    df = rows.select("row_id", F.lit(1).alias("group_id"), (F.col("row_id") % 3).alias("label"))
    got = pairs.rank_pairs(df, pairs_per_row=2)
    assert got.count() == 1600 and got.where("high_label <= low_label").count() == 0


CV = [[0.6, 0.0, 0.6, 0.6], [0.7, 0.0, 0.7, 0.4], [0.8, 0.0, 0.8, 0.2]]


def oof(spark, repeats=CV):
    data = [(i, r, i % 2, [1.0, 0.0, 1.0, 0.0][i], p) for r, row in enumerate(repeats) for i, p in enumerate(row)]
    df = spark.createDataFrame(data, "row_id int, repeat int, fold int, label double, raw double")
    pred, prob = V.recorded_columns(F.col("raw"), False, True)
    return df.select("row_id", "repeat", "fold", "label", pred.alias("pred"), prob.alias("prob"))


def test_aggregated_predictions(spark):
    got = V.cv_aggregate_predictions(oof(spark), True).sort("row_id").collect()
    assert [r["prob"] for r in got] == pytest.approx([0.7, 0.0, 0.7, 0.4]) and [r["pred"] for r in got] == [1.0, 0.0, 1.0, 0.0]


def test_missing_and_repeated_predictions_are_errors(spark):
    ids = spark.range(4).select(F.col("id").cast("int").alias("row_id"))
    V.check_complete(ids, oof(spark), 3)
    with pytest.raises(ValueError):
        V.check_complete(ids, oof(spark, CV[:2]), 3)
    with pytest.raises(ValueError):
        V.check_complete(ids, oof(spark), 2)
    assert V.cv_repeated_rows(oof(spark), 2).count() == 4


@pytest.mark.parametrize("bad", [
    {}, {"num_round": 0}, {"num_round": "x"}, {"num_round": 1, "colour": 1}, {"num_round": 1, "eta": 2}, {"num_round": 1, "subsample": 0},
    {"num_round": 1, "objective": "multi:softprob"}, {"num_round": 1, "objective": "aft_loss_distribution"},
    {"num_round": 1, "objective": "reg:squarederror", "eval_metric": "auc"}, {"num_round": 1, "eval_metric": "rmse@3"},
    {"num_round": 1, "eval_metric": "error@x"}, {"num_round": 1, "monotone_constraints": "(1,0)"},
    {"num_round": 1, "booster": "gblinear", "updater": "refresh"}, {"num_round": 1, "process_type": "update", "updater": "sync"},
    {"num_round": 1, "tweedie_variance_power": 2}, {"num_round": 1, "interaction_constraints": "[[0,1]]", "tree_method": "hist"},
])
def test_rejected_parameters(bad):
    with pytest.raises(ValueError):
        resolve_parameters(bad)


def test_accepted_parameters():
    p = resolve_parameters({"num_round": "5", "learning_rate": "0.1", "eval_metric": "error@0.7,ndcg@5", "sketch_eps": 0.1, "reg_alpha": 2})
    assert (p["num_round"], p["eta"], p["alpha"], p["max_bin"]) == (5, 0.1, 2.0, 10)


def test_user_hooks(spark):
    df = spark.createDataFrame([(1, "1,2\n3,4"), (2, "1,x")], "request_id int, body string")
    got = {r["request_id"]: r for r in score_with_user_hooks(df, lambda d: (lambda x: [sum(r) for r in x])).collect()}
    assert got[1]["response"] == "3.0\n7.0" and got[2]["error"]
    one = score_with_user_hooks(df, lambda d: "m", transform_fn=lambda m, b, c, a: m + b).collect()
    assert {r["response"] for r in one} == {"m1,2\n3,4", "m1,x"}
    with pytest.raises(ValueError):
        score_with_user_hooks(df, lambda d: None, transform_fn=lambda *a: "", output_fn=lambda *a: "")


@pytest.mark.parametrize("objective", ["rank:ndcg", "rank:map", "survival:cox"])
def test_group_gradients_do_not_depend_on_ranges(spark, rows, monkeypatch, objective):
    from treeline.operators.group_gradients import group_gradients

    df = rows.select(
        "row_id", F.when(F.col("row_id") % 3 == 0, 0).otherwise(F.col("row_id") % 11).alias("group_id"),
        (F.col("row_id") % 4).cast("double").alias("label"), (F.col("row_id") * 31 % 17 / 5.0).alias("m_0"), F.lit(1.0).alias("w"),
    )
    plain = {r["row_id"]: (r["g_0"], r["h_0"]) for r in group_gradients(df, objective, DEFAULTS).collect()}
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(ordering, "HOT_KEYS", 10)
    cut = {r["row_id"]: (r["g_0"], r["h_0"]) for r in group_gradients(df, objective, DEFAULTS).collect()}
    assert set(plain) == set(cut) and len(plain) == 800
    for k in plain:
        assert cut[k] == pytest.approx(plain[k], abs=1e-9)


def _exchanges(df):
    """Exchanges of a plan, without those that filled a cache."""
    found, cache = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if cache is None or depth <= cache:
            cache = depth if "InMemoryRelation" in line else None
            found += [line] if "Exchange" in line else []
    return found


@pytest.mark.parametrize("objective", ["rank:pairwise", "rank:ndcg", "rank:map"])
def test_ranking_gradients_of_small_groups_stay_where_their_rows_lie(spark, monkeypatch, objective):
    from treeline.operators import group_gradients as GG

    df = spark.range(900).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") < 150, 0).otherwise(F.col("id") % 60).alias("group_id"),
        F.when(F.col("id") % 41 == 0, None).otherwise((F.col("id") * 7 % 4).cast("double")).alias("label"),
        (F.col("id") * 31 % 17 / 5.0).alias("m_0"), F.lit(2.0).alias("w"), F.array(F.col("id").cast("short")).alias("bins"),
    ).repartition(3, "group_id").persist()
    df.count()
    found = GG.group_gradients(df, objective, DEFAULTS, GG.Layout("group_id"))
    assert not _exchanges(found)
    local = {r["row_id"]: r for r in found.collect()}
    spread = {r["row_id"]: r for r in GG._spread_gradients(df, objective, DEFAULTS).collect()}
    monkeypatch.setattr(GG, "GROUP_ROWS", 100)
    assert GG.layout(df, objective).hot.collect() == [(0,)]
    mixed = {r["row_id"]: r for r in GG.group_gradients(df, objective, DEFAULTS).collect()}
    assert set(local) == set(spread) == set(mixed) and len(local) == 900
    for k, row in local.items():
        assert row["bins"] == [k]
        for other in (spread[k], mixed[k]):
            assert (row["g_0"], row["h_0"]) == pytest.approx((other["g_0"], other["h_0"]), abs=1e-9)
    df.unpersist()


def test_groups_that_span_batches_and_repeated_ids(spark):
    from treeline.operators import group_gradients as GG

    df = spark.range(300).select(
        F.col("id").alias("row_id"), F.floor(F.col("id") / 37).alias("group_id"), (F.col("id") % 3).cast("double").alias("label"),
        (F.col("id") % 7 / 3.0).alias("m_0"), F.lit(1.0).alias("w"),
    )
    def flat(rows):
        return [v for r in sorted(rows.collect()) for v in r]

    whole = flat(GG.group_gradients(df, "rank:ndcg", DEFAULTS))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert flat(GG.group_gradients(df, "rank:ndcg", DEFAULTS)) == pytest.approx(whole)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    twice = df.withColumn("row_id", F.floor(F.col("row_id") / 2))
    assert not GG.layout(twice, "rank:ndcg").unique
    assert flat(GG.group_gradients(twice, "rank:ndcg", DEFAULTS)) == pytest.approx(flat(GG._spread_gradients(twice, "rank:ndcg", DEFAULTS)))


@pytest.mark.parametrize("objective, key", [("rank:ndcg", "group_id"), ("survival:cox", "time")])
def test_rounds_of_grouped_objectives_shuffle_no_row(spark, monkeypatch, objective, key):
    from treeline.plans import boosting

    df = spark.range(600).select(
        F.col("id").alias("row_id"), (F.col("id") % 60).alias("group_id"), (F.col("id") * 7 % 5 + 1).cast("double").alias("label"),
        F.array((F.col("id") % 9).cast("double")).alias("features"),
    )
    frames, passes = [], []
    gradients, evaluate = boosting.row_gradients, boosting.evaluate_named
    monkeypatch.setattr(boosting, "row_gradients", lambda rows, *a: frames.append(_exchanges(rows.groupBy(key).agg(F.sum("m_0")))) or gradients(rows, *a))
    monkeypatch.setattr(boosting, "evaluate_named", lambda *a: passes.append(a[1]) or evaluate(*a))
    model = fit_boosted_trees(df, {"objective": objective, "num_round": 2, "max_depth": 2, "max_bin": 8})
    # as many gradients as rounds, as many values as log lines, and totals per key without a shuffle
    assert len(model.trees) == len(model.log) == len(passes) == len(frames) == 2
    assert not frames[0] and not frames[1]


def test_salted_lookup_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 20)
    monkeypatch.setattr(ordering, "HOT_KEYS", 10)
    big = spark.range(300).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = ordering.salted_lookup(big, small, ["k"])
    assert got.count() == 300 and got.where("v <> k * 2").count() == 0


def test_literal_and_array_features_with_nan(spark):
    df = spark.createDataFrame([(float(i % 2), [float(i % 2), float("nan"), None]) for i in range(40)], "label double, features array<double>")
    model = fit_boosted_trees(df, {"num_round": 1, "max_depth": 2, "max_bin": 4, "eta": 1.0, "lambda": 0})
    assert {(r["label"], round(r["prediction"], 6)) for r in predict_trees(df, model).collect()} == {(0.0, 0.0), (1.0, 1.0)}


def as_map(rows):
    """The same rows with a map of the features that are there."""
    entries = F.filter(F.transform("features", lambda v, i: F.struct(i.cast("int").alias("k"), v.alias("v"))), lambda e: e["v"].isNotNull())
    return rows.withColumn("features", F.map_from_entries(entries))


@pytest.mark.parametrize("extra", [
    {}, {"grow_policy": "lossguide", "max_leaves": 5}, {"monotone_constraints": [1, -1, 0], "tree_method": "hist", "colsample_bynode": 0.7},
    {"booster": "dart", "rate_drop": 0.5, "subsample": 0.8},
])
def test_sparse_rows_give_the_trees_of_dense_ones(spark, rows, monkeypatch, extra):
    params = {"num_round": 2, "max_depth": 3, "max_bin": 32, **extra}
    dense, sparse = fit_boosted_trees(rows, params), fit_boosted_trees(as_map(rows), params, validation=as_map(rows))
    assert sparse.node_rows() == dense.node_rows()
    assert losses(sparse) == pytest.approx(losses(dense)) and losses(sparse, "validation") == pytest.approx(losses(dense))
    both = predict_trees(predict_trees(as_map(rows), sparse), sparse, output="again")
    wanted = {r["row_id"]: r["prediction"] for r in predict_trees(rows, dense).collect()}
    assert {r["row_id"]: r["prediction"] for r in both.collect()} == wanted
    monkeypatch.setattr(scoring, "LITERAL_NODES", 1)
    monkeypatch.setattr(scoring, "SLICE_CELLS", 50)
    assert {r["row_id"]: r["prediction"] for r in predict_trees(as_map(rows), sparse).collect()} == pytest.approx(wanted)


def test_sparse_subtraction_and_refresh(spark, rows, monkeypatch):
    params = {"num_round": 2, "max_depth": 3, "max_bin": 32}
    model = fit_boosted_trees(as_map(rows), params)
    assert refresh_trees(as_map(rows), model).node_rows() == refresh_trees(rows, model).node_rows()
    monkeypatch.setattr(boosting, "SUBTRACT_CELLS", 0)
    assert fit_boosted_trees(as_map(rows), params).node_rows() == model.node_rows()


def test_wide_sparse_rows(spark):
    """A hundred thousand indices of which fifty are there; absent, null, NaN and empty maps are missing values."""
    keys = F.expr("transform(sequence(0, 49), i -> cast(3 + abs(xxhash64(id, i)) % 99990 AS int))")
    entries = F.concat(
        F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), ((k + F.col("id")) % 7).cast("double").alias("v"))),
        F.array(F.struct(F.lit(99_999).alias("k"), F.when(F.col("id") % 5 > 2, F.lit(1.0)).otherwise(F.lit(float("nan"))).alias("v"))),
    )
    df = spark.range(2000).select(F.when(F.col("id") % 10 > 0, F.map_from_entries(entries)).alias("features"), (F.col("id") % 5 > 2).cast("double").alias("label"))
    model = fit_boosted_trees(df, {"num_round": 1, "max_depth": 2, "max_bin": 16, "base_score": 0.0, "lambda": 0.0, "eta": 1.0})
    root = model.trees[0][0]
    assert model.n_features == 100_000 and root.feature[0] == 99_999
    scored = predict_trees(df, model)
    assert scored.where("features is not null").agg(F.max(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 0.2
    other = spark.createDataFrame([({200_000: 1.0},), ({},), (None,)], "features map<int,double>")
    assert len({r["prediction"] for r in predict_trees(other, model).collect()}) == 1
    with pytest.raises(ValueError, match="indices"):
        fit_boosted_trees(spark.createDataFrame([({-1: 1.0}, 1.0)], "features map<int,double>, label double"), {"num_round": 1})
    with pytest.raises(ValueError, match="dense_features"):
        predict_contribs(other, model)


def brute_shapley(trees, x, width):
    """The subset formula, tree by tree: features that aren't known send a row both ways, by cover."""

    def mean(t, n, known):
        f = t.feature[n]
        if f < 0:
            return t.value[n] * t.scale
        left, right = t.left[n], t.right[n]
        if f in known:
            v = x[f] if f < len(x) and x[f] is not None else float("nan")
            return mean(t, left if (t.default_left[n] if v != v else v < t.split[n]) else right, known)
        a, b = t.cover[left], t.cover[right]
        return (a * mean(t, left, known) + b * mean(t, right, known)) / (a + b)

    out = [0.0] * width
    for f in range(width):
        others = [o for o in range(width) if o != f]
        for size in range(width):
            weight = math.factorial(size) * math.factorial(width - 1 - size) / math.factorial(width)
            for known in itertools.combinations(others, size):
                out[f] += weight * sum(mean(t, 0, {*known, f}) - mean(t, 0, set(known)) for t in trees)
    return [*out, sum(mean(t, 0, set()) for t in trees)]


@pytest.mark.parametrize("params", [{"max_depth": 5, "num_round": 3}, {"max_depth": 2, "num_round": 3, "booster": "dart", "rate_drop": 0.5, "one_drop": 1}])
def test_shapley_values_equal_the_subset_formula(spark, rows, params):
    model = fit_boosted_trees(rows, {"max_bin": 16, **params})
    some = rows.where("row_id % 29 = 0 OR row_id % 13 = 0 AND row_id % 3 = 0")
    for r in predict_contribs(some, model).collect():
        wanted = brute_shapley(model.used_trees(), r["features"], 3)
        wanted[-1] += model.base_margin
        assert r["contribs"] == pytest.approx(wanted, abs=1e-9)
    paths = predict_contribs(predict_trees(some, model, output="m", margin=True), model, method="path")
    assert paths.where(F.abs(F.aggregate("contribs", F.lit(0.0), lambda x, y: x + y) - F.col("m")) > 1e-9).count() == 0
    model.trees[0][0].cover[0] = 0.0
    with pytest.raises(ValueError, match="covers"):
        predict_contribs(some, model)


@pytest.mark.parametrize("rows, batch", [(30, 1000), (60_000, 500)])
def test_weighted_cuts_keep_their_ranks(spark, monkeypatch, rows, batch):
    monkeypatch.setattr(sketches, "POINTS", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        r = np.random.default_rng(5)
        a, b, w = np.round(r.gamma(2.0, 5.0, rows), 3), r.integers(0, 5, rows).astype(float), r.integers(0, 4, rows).astype(float)
        w[a > 25] *= 20
        b[:3] = np.nan
        data = [(float(z), [float(x), None if np.isnan(y) else float(y)]) for x, y, z in zip(a, b, w)] + [(None, [1e9, -1e9])]
        frame = spark.createDataFrame(data, "weight double, features array<double>").repartition(5)
        got = {x.feature: x for x in sketches.weighted_feature_bins(frame, 16).collect()}
        assert got[1].cuts == sorted(set(b[(w > 0) & ~np.isnan(b)].tolist()))[1:] and got[1].mass == w[~np.isnan(b)].sum()
        order = np.argsort(a)
        ends = np.cumsum(w[order]) / w.sum()
        ranks = [ends[np.searchsorted(a[order], c, side="right") - 1] for c in got[0].cuts]
        if rows > 1000:
            assert len(ranks) == 15 and all(abs(x - (i + 1) / 16) <= 1 / 16 for i, x in enumerate(ranks))
        sparse = frame.withColumn("features", F.map_from_arrays(F.sequence(F.lit(0), F.lit(1)), "features"))
        assert {x.feature for x in sketches.weighted_feature_bins(sparse, 16).collect()} == {0, 1}
        assert sketches.weighted_feature_bins(frame.where("weight < 0"), 16).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_merged_summary_moves_no_rank_by_more_than_its_share():
    r = np.random.default_rng(6)
    v, m = r.normal(size=5000), r.random(5000)
    m[17] = 900.0
    kept, mass = sketches.merge([v[:2000], v[2000:]], [m[:2000], m[2000:]], 100)
    assert len(kept) <= 100 and mass.sum() == pytest.approx(m.sum()) and v[17] in kept
    order = np.argsort(v)
    true = np.cumsum(m[order])
    held = np.concatenate(([0.0], np.cumsum(mass)))[np.searchsorted(kept, v[order], side="right")]
    assert np.abs(true - held).max() <= m.sum() / 100 + 1e-6


def test_absolute_error_leaves_are_weighted_medians(spark):
    r = np.random.default_rng(8)
    side, y, w = r.integers(0, 2, 500), np.round(r.gamma(2.0, 3.0, 500), 2), r.integers(1, 9, 500).astype(float)
    frame = spark.createDataFrame([(i, float(b), float(c), [float(a)]) for i, (a, b, c) in enumerate(zip(side, y + 9 * side, w))], "row_id long, label double, weight double, features array<double>")
    model = fit_boosted_trees(frame.repartition(6), {"objective": "reg:absoluteerror", "num_round": 1, "max_depth": 1, "eta": 1.0, "base_score": 9.0})
    got = {}
    for x in predict_trees(frame, model).join(frame.select("row_id", F.col("features")[0].alias("side")), "row_id").collect():
        got[x.side] = x.prediction
    for s in (0, 1):
        own = np.sort(y[side == s] + 9 * s)
        mass = np.cumsum(w[side == s][np.argsort(y[side == s] + 9 * s)])
        # the margin starts at 9; the leaf holds the median residual
        assert got[float(s)] == pytest.approx(own[np.searchsorted(mass, mass[-1] / 2)])


def test_sums_of_few_features_need_no_python(spark, monkeypatch):
    from treeline.plans import linear

    df = spark.range(200).select(
        (F.col("id") % 3).cast("double").alias("label"), (1.0 + F.col("id") % 2).alias("weight"),
        F.array((F.col("id") % 7 / 3.0), F.when(F.col("id") % 5 > 0, F.col("id") % 5 / 2.0)).alias("features"),
    )
    params = {"objective": "count:poisson", "num_round": 4, "lambda": 0.1}
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "mapInArrow", None)
        native = linear.fit_linear(df, params)
    monkeypatch.setattr(linear, "NARROW", 0)
    monkeypatch.setattr(linear, "NARROW_SUMS", 0)
    batches = linear.fit_linear(df, params)
    assert native.bias == pytest.approx(batches.bias) and native.weights[0] == pytest.approx(batches.weights[0])
