"""Updating existing trees: new leaf values from new data, and pruning of weak splits."""

from __future__ import annotations

import copy
import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from treeline.operators import gradients as G
from treeline.operators import routing
from treeline.operators.histograms import weight_sql
from treeline.plans.boosting import plain_rows, row_gradients
from treeline.plans.model import Model
from treeline.plans.scoring import predict_leaf


def leaf_statistics(df: DataFrame, model: Model, params: dict) -> DataFrame:
    """``tree, leaf, g, h, n, weight`` of every leaf at the model's starting margin, from one pass over the rows."""
    rows = predict_leaf(df, model).withColumn("m_0", F.lit(float(model.base_margin)))
    weight = "weight" if "weight" in df.columns else None
    rows = G.gradient_pairs(rows, model.objective, params, weight=weight)
    long = rows.select("g_0", "h_0", F.posexplode("leaves").alias("tree", "leaf"))
    sums = long.groupBy("tree", "leaf").agg(F.sum("g_0").alias("g"), F.sum("h_0").alias("h"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("weight", F.expr(f"{weight_sql('g', 'h', params)} * {float(params['eta'])!r}D"))


def leaf_value(g: float, h: float, p: dict) -> float:
    """The value ``weight_sql`` gives, for sums on the driver, times the learning rate of one of the parallel trees."""
    lam, alpha, step = float(p["lambda"]), float(p.get("alpha") or 0.0), float(p.get("max_delta_step") or 0.0)
    if h + lam <= 0:
        return 0.0
    w = -math.copysign(max(abs(g) - alpha, 0.0), g) / (h + lam)
    if step > 0:
        w = max(min(w, step), -step)
    return w * float(p["eta"]) / int(p.get("num_parallel_tree") or 1)


def refresh_trees(df: DataFrame, model: Model, params: dict | None = None, gamma: float | None = None) -> Model:
    """The same splits with values, covers and gains of the new rows; each round sees the margin of those before.

    With ``gamma``, each round is pruned by its new gains before the next one is refreshed.
    """
    p = {**model.params, **(params or {})}
    out = copy.deepcopy(model)
    margins = [f"m_{i}" for i in range(model.n_outputs)]
    rows = plain_rows(df, margins, model.base_margin, p)
    lam, alpha, held = float(p["lambda"]), float(p.get("alpha") or 0.0), None
    for number, trees in enumerate(out.trees):
        nodes = [f"r_{t}" for t in range(len(trees))]
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        grad = row_gradients(rows, model.objective, p, margins, number)
        placed = routing.route(grad, trees, nodes, False, "features")
        entries = F.explode(F.array(*[
            F.struct(F.lit(t).alias("t"), F.col(n).alias("n"), F.col(f"g_{tree.group}").alias("g"), F.col(f"h_{tree.group}").alias("h"))
            for t, (tree, n) in enumerate(zip(trees, nodes))
        ])).alias("e")
        sums = placed.select(entries).groupBy("e.t", "e.n").agg(F.sum("e.g").alias("g"), F.sum("e.h").alias("h")).collect()
        if held is not None:
            held.unpersist()
        held = rows
        for t, tree in enumerate(trees):
            g, h = [0.0] * len(tree.feature), [0.0] * len(tree.feature)
            for r in sums:
                if r["t"] == t:
                    g[r["n"]], h[r["n"]] = r["g"], r["h"]
            for n in reversed(range(len(tree.feature))):
                if tree.feature[n] >= 0:
                    left, right = tree.left[n], tree.right[n]
                    g[n], h[n] = g[left] + g[right], h[left] + h[right]
                    score = [max(abs(gg) - alpha, 0.0) ** 2 / (hh + lam) if hh + lam > 0 else 0.0 for gg, hh in ((g[left], h[left]), (g[right], h[right]), (g[n], h[n]))]
                    tree.gain[n] = 0.5 * (score[0] + score[1] - score[2])
                tree.cover[n] = h[n]
                if int(p.get("refresh_leaf", 1)):
                    tree.value[n] = leaf_value(g[n], h[n], p)
            if gamma is not None:
                _prune(tree, gamma)
        rows = routing.add_tree_values(routing.route(rows, trees, nodes, False, "features"), trees, nodes, margins)
    if held is not None:
        held.unpersist()
    return out


def _prune(tree: routing.Tree, gamma: float) -> None:
    for n in reversed(range(len(tree.feature))):
        if tree.feature[n] >= 0 and tree.gain[n] < gamma and tree.feature[tree.left[n]] < 0 and tree.feature[tree.right[n]] < 0:
            tree.feature[n] = tree.left[n] = tree.right[n] = -1


def prune_trees(model: Model, gamma: float) -> Model:
    """Splits with a gain below ``gamma`` whose children are leaves become leaves, bottom up."""
    out = copy.deepcopy(model)
    for trees in out.trees:
        for tree in trees:
            _prune(tree, gamma)
    return out


def update_trees(df: DataFrame, start: Model, p: dict) -> Model:
    """``process_type=update``: the first ``num_round`` rounds of ``start`` after the updaters, in their order."""
    updaters, rounds = p.get("updater") or [], int(p["num_round"])
    if not updaters:
        raise ValueError("process_type update needs updater refresh, prune or both")
    if p["objective"] != start.objective:
        raise ValueError(f"the model to update has objective {start.objective}, not {p['objective']}")
    if rounds > len(start.trees):
        raise ValueError(f"process_type update has {len(start.trees)} rounds to update, num_round is {rounds}")
    out = Model(start.objective, p, start.base_margin, start.n_features, start.n_outputs, copy.deepcopy(start.trees[:rounds]), index_base=start.index_base)
    gamma = float(p.get("gamma") or 0.0)
    refresh = updaters.index("refresh") if "refresh" in updaters else len(updaters)
    if "prune" in updaters[:refresh]:
        out = prune_trees(out, gamma)
    if refresh < len(updaters):
        out = refresh_trees(df, out, p, gamma if "prune" in updaters[refresh:] else None)
    return out
