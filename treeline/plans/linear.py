"""Linear booster: cyclic coordinate descent on the second-order form of any row objective.

A round needs, per class, the sums of g, h*x and h*x*x' over all rows. Of a few features these are plain sums; of more they
are added up per Arrow batch with numpy, per column of the sum by Spark. The (small) matrix reaches the driver. There the coordinates are
stepped through one after the other: a step moves the gradient of the others by a known amount, so the result equals
one pass over the rows per coordinate. Wide rows are cut into blocks of ``BLOCK`` features with one pass each. With a
squared error the matrix stays the same, and all rounds of one block share a single pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from treeline.operators.gradients import ROW_OBJECTIVES, base_margin, default_base, gradient_pairs, is_multiclass, link
from treeline.plans.boosting import evaluate_margins
from treeline.plans.parameters import resolve_parameters

SQUARED = ("reg:squarederror", "reg:linear")
BLOCK = 64
NARROW = 8  # features whose margin is written out term by term
NARROW_SUMS = 64  # up to so many sums are Spark's own
ETA = 0.5
CONVERGED = 1e-12  # rounds end once no value moves by more than this part of itself


@dataclass
class LinearModel:
    """``weights[class][feature]`` and ``bias[class]`` on the margin scale, which starts at ``base``."""

    objective: str
    weights: list[list[float]]
    bias: list[float]
    base: float
    rounds: int = 0
    log: list[dict] = field(default_factory=list)


def _plain(features: Column) -> Column:
    return F.transform(features, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))


def _margins(model: LinearModel, features: Column) -> list[Column]:
    out = []
    for w, b in zip(model.weights, model.bias, strict=True):
        if len(w) <= NARROW:
            out.append(sum((F.get(features, F.lit(i)) * F.lit(float(x)) for i, x in enumerate(w)), F.lit(model.base + b)))
            continue
        weights = F.array(*[F.lit(float(x)) for x in w]).cast("array<double>")
        out.append(F.aggregate(F.zip_with(features, weights, lambda x, y: x * y), F.lit(model.base + b), lambda a, x: a + x))
    return out


def _named_margins(model: LinearModel) -> list[Column]:
    return [m.alias(f"m_{k}") for k, m in enumerate(_margins(model, F.col("features")))]


def _sums(rows: DataFrame, classes: int, first: int, size: int, with_bias: bool) -> dict[int, np.ndarray]:
    """Per class a matrix: its first column holds the sums of g times each coordinate, the others those of h times two."""
    width = size + with_bias
    if classes * width * (width + 3) // 2 <= NARROW_SUMS:
        return _plain_sums(rows, classes, first, size, with_bias)
    names = [f"{kind}_{k}" for k in range(classes) for kind in "gh"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, width, width + 1))
        for batch in batches:
            n = batch.num_rows
            lists = batch.column(0)
            x = np.asarray(lists.flatten()).reshape(n, size) if n else np.zeros((0, size))
            if with_bias:
                x = np.hstack([np.ones((n, 1)), x])
            for k in range(classes):
                g, h = np.asarray(batch.column(1 + 2 * k)), np.asarray(batch.column(2 + 2 * k))
                total[k, :, 0] += x.T @ g
                total[k, :, 1:] += x.T @ (x * h[:, None])
        lines = [[k, i] for k in range(classes) for i in range(width)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in lines], pa.int32()), pa.array([i for _, i in lines], pa.int32()), pa.array([total[k, i].tolist() for k, i in lines], pa.list_(pa.float64()))],
            ["k", "i", "line"],
        )

    block = F.slice("features", first + 1, size).alias("features")
    parts = rows.select(block, *names).mapInArrow(add, "k int, i int, line array<double>")
    summed = parts.groupBy("k", "i").agg(F.array(*[F.sum(F.get("line", F.lit(j))) for j in range(width + 1)]).alias("line"))
    out = {k: np.zeros((width, width + 1)) for k in range(classes)}
    for r in summed.collect():  # classes times the block's width
        out[r["k"]][r["i"]] = r["line"]
    return out


def _plain_sums(rows: DataFrame, classes: int, first: int, size: int, with_bias: bool) -> dict[int, np.ndarray]:
    """The same matrices from one aggregate: its lower triangles are mirrored."""
    x = ([F.lit(1.0)] if with_bias else []) + [F.col(f"x_{first + i}") for i in range(size)]
    shown = [F.get("features", F.lit(first + i)).alias(f"x_{first + i}") for i in range(size)]
    rows = rows.select(*shown, *[f"{kind}_{k}" for k in range(classes) for kind in "gh"])
    spots = [(k, i, j) for k in range(classes) for i in range(len(x)) for j in range(i + 2)]
    terms = [x[i] * F.col(f"g_{k}") if j == 0 else x[i] * x[j - 1] * F.col(f"h_{k}") for k, i, j in spots]
    found = rows.agg(*[F.sum(t) for t in terms]).first() if terms else ()
    out = {k: np.zeros((len(x), len(x) + 1)) for k in range(classes)}
    for (k, i, j), value in zip(spots, found, strict=True):
        out[k][i, j] = value or 0.0
        if j:
            out[k][j - 1, i + 1] = value or 0.0
    return out


def _descend(sums: np.ndarray, w: np.ndarray, l1: np.ndarray, l2: np.ndarray, eta: float) -> np.ndarray:
    """Steps every coordinate once, in order; ``sums`` gets the gradients after the steps. Returns the new values."""
    w = w.copy()
    for i in range(len(w)):
        h = sums[i, 1 + i]
        if h + l2[i] < 1e-12:
            continue
        pull = h * w[i] - sums[i, 0]
        step = eta * (np.sign(pull) * max(abs(pull) - l1[i], 0.0) / (h + l2[i]) - w[i])
        w[i] += step
        sums[:, 0] += sums[:, 1 + i] * step
    return w


def fit_linear(df: DataFrame, params: dict, validation: DataFrame | None = None) -> LinearModel:
    """A linear model on ``label, features array<double>[, weight]`` (and what the objective needs) for any row objective.

    ``lambda``, ``alpha`` and ``lambda_bias`` count per unit of row weight, so a penalty keeps its meaning when rows are
    repeated; ``alpha`` never acts on the intercept. Both values of ``updater`` step in the same order. Missing values
    count as zero; rows must be of one width. With ``eval_metric`` every round's values are logged for ``train`` and,
    if given, ``validation``; without, rounds that would change nothing are left out. A table without rows raises.
    """
    p = resolve_parameters({**params, "booster": "gblinear"})
    objective = p["objective"]
    if objective not in ROW_OBJECTIVES:
        raise ValueError(f"the linear booster has no objective {objective}")
    classes = int(p["num_class"]) if is_multiclass(objective) else 1
    eta = float(p["eta"]) if {"eta", "learning_rate"} & set(params) else ETA
    base = base_margin(objective, float(p["base_score"]) if params.get("base_score") is not None else default_base(objective))
    rows = _prepared(df)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        unfit = F.col("features").isNull() | F.col("weight").isNull() | F.col("label_lower" if objective == "survival:aft" else "label").isNull()
        seen = rows.agg(F.min(F.size("features")), F.max(F.size("features")), F.sum("weight"), F.sum(unfit.cast("int"))).first()
        if seen[0] is None or seen[0] != seen[1] or seen[3]:
            raise ValueError("the linear booster needs rows with labels, weights and features, all of one width")
        d, mass = seen[0], float(seen[2])
        model = LinearModel(objective, [[0.0] * d for _ in range(classes)], [0.0] * classes, base)
        rounds, metrics = max(int(p["num_round"]), 1), list(p.get("eval_metric") or [])
        penalty = {n: mass * float(params.get(n, params.get(f"reg_{n}", 0.0)) or 0.0) for n in ("lambda", "alpha", "lambda_bias")}
        once = objective in SQUARED and d <= BLOCK
        kept = None
        sets = {"train": rows} | ({"validation": _prepared(validation)} if validation is not None else {})
        for r in range(rounds):
            moved = 0.0
            for first in range(0, max(d, 1), BLOCK):
                size, with_bias = min(BLOCK, d - first), first == 0
                if kept is None or not once:
                    named = gradient_pairs(rows.select("*", *_named_margins(model)), objective, p, margins=tuple(f"m_{k}" for k in range(classes)))
                    kept = _sums(named, classes, first, size, with_bias)
                l1 = np.full(size + with_bias, penalty["alpha"])
                l2 = np.full(size + with_bias, penalty["lambda"])
                if with_bias:
                    l1[0], l2[0] = 0.0, penalty["lambda_bias"]
                for k in range(classes):
                    held = ([model.bias[k]] if with_bias else []) + model.weights[k][first : first + size]
                    new = _descend(kept[k], np.array(held), l1, l2, eta).tolist()
                    moved = max([moved, *(abs(a - b) / (1.0 + abs(a)) for a, b in zip(new, held, strict=True))])
                    if with_bias:
                        model.bias[k] = new.pop(0)
                    model.weights[k][first : first + size] = new
            model.rounds = r + 1
            for name, data in sets.items() if metrics else ():
                scored = data.select("*", F.col("weight").alias("w"), *_named_margins(model))
                values = evaluate_margins(scored, objective, metrics, p, [f"m_{k}" for k in range(classes)])
                model.log += [{"round": r, "dataset": name, "metric": m, "value": v} for m, v in zip(metrics, values, strict=True)]
            if not metrics and moved <= CONVERGED:
                break
        return model
    finally:
        rows.unpersist()


def _prepared(df: DataFrame) -> DataFrame:
    also = [c for c in ("label_lower", "label_upper", "group_id", "row_id") if c in df.columns]
    return df.select(
        (F.col("label").cast("double") if "label" in df.columns else F.lit(None).cast("double")).alias("label"),
        (F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)).alias("weight"),
        _plain(F.col("features")).alias("features"),
        *also,
    )


def predict_linear(df: DataFrame, model: LinearModel, output: str = "prediction") -> DataFrame:
    """Replaces ``features`` by the prediction of a fitted linear model."""
    value = link(model.objective, _margins(model, _plain(F.col("features"))))
    return df.select(*[c for c in df.columns if c != "features"], value.alias(output))
