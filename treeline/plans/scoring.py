"""Scoring a table with a stored ensemble.

Small ensembles become literal lookups inside generated code. Larger ones are cut into pieces of bounded size;
each piece is broadcast and walked level by level with numpy inside Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from treeline.operators import routing
from treeline.operators.ensembles import VOTED
from treeline.operators.gradients import link
from treeline.operators.routing import Tree
from treeline.plans.model import Model

# Batch functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LITERAL_NODES = 2_000
BROADCAST_NODES = 2_000_000
SLICE_CELLS = 4_000_000


def _pieces(trees: Sequence[Tree], limit: int) -> Iterator[list[Tree]]:
    piece: list[Tree] = []
    size = 0
    for t in trees:
        if piece and size + len(t.feature) > limit:
            yield piece
            piece, size = [], 0
        piece.append(t)
        size += len(t.feature)
    if piece:
        yield piece


def _packed(trees: Sequence[Tree]) -> dict[str, np.ndarray]:
    """Node arrays of several trees end to end, child ids made absolute."""
    starts = np.cumsum([0] + [len(t.feature) for t in trees])
    offset = np.repeat(starts[:-1], [len(t.feature) for t in trees])
    flat = {n: np.concatenate([np.asarray(getattr(t, n)) for t in trees]) for n in ("feature", "split", "default_left", "left", "right", "value", "cover")}
    flat["left"], flat["right"] = flat["left"] + offset, flat["right"] + offset
    flat["value"] = flat["value"] * np.repeat([t.scale for t in trees], [len(t.feature) for t in trees])
    flat["start"], flat["group"] = starts[:-1], np.array([t.group for t in trees])
    flat["depth"] = np.array([t.max_depth() for t in trees])
    return flat


def _matrix(features: pd.Series, width: int) -> np.ndarray:
    if len(features) and (features.str.len() == width).all():
        return np.vstack(features.to_numpy()).astype(float)
    out = np.full((len(features), width), np.nan)
    for i, row in enumerate(features):
        values = np.asarray(row, dtype=float)[:width]
        out[i, : len(values)] = values
    return out


def _sparse_matrices(features: pa.Array, used: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First row and values of the ``used`` features, of slices of a map column; what is absent is NaN."""
    ends = np.asarray(features.offsets, dtype=np.int64)
    index, value = (x.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for x in (features.keys, features.items))
    ends = ends - ends[0]
    at = np.minimum(np.searchsorted(used, index), max(len(used) - 1, 0))
    known = used[at] == index if len(used) else np.zeros(len(index), dtype=bool)
    row = np.repeat(np.arange(len(features)), np.diff(ends))
    step = max(1, SLICE_CELLS // max(len(used), 1))
    for start in range(0, len(features), step):
        stop = min(start + step, len(features))
        here = np.flatnonzero(known[ends[start] : ends[stop]]) + ends[start]
        x = np.full((stop - start, len(used)), np.nan)
        x[row[here] - start, at[here]] = value[here]
        yield start, x


def _walk(x: np.ndarray, flat: dict, tree: int) -> Iterator[np.ndarray]:
    """Node of every row after each level, starting with the root."""
    node = np.full(len(x), flat["start"][tree])
    rows = np.arange(len(x))
    yield node
    for _ in range(flat["depth"][tree]):
        f = flat["feature"][node]
        v = x[rows, np.maximum(f, 0)]
        left = np.where(np.isnan(v), flat["default_left"][node], v < flat["split"][node])
        node = np.where(f < 0, node, np.where(left, flat["left"][node], flat["right"][node]))
        yield node


def add_margins(df: DataFrame, model: Model, margins: list[str], features: str = "features", rounds: int | None = None) -> DataFrame:
    """Adds the summed leaf values plus the base margin, one column per class.

    Leaf values are added to the margin one by one, in the order of the trees, by either path: the bits of the sum don't
    depend on the size of the ensemble.
    """
    trees = [t for r in model.trees[: rounds if rounds is not None else len(model.trees)] for t in r]
    df = df.select("*", *[F.lit(float(model.base_margin)).alias(m) for m in margins])
    if sum(len(t.feature) for t in trees) <= LITERAL_NODES:
        for piece in _pieces(trees, 512):
            nodes = [f"__p_{i}" for i in range(len(piece))]
            df = routing.add_tree_values(routing.route(df, piece, nodes, False, features), piece, nodes, margins)
        return df
    width, k = model.n_features, len(margins)
    sparse = routing.is_sparse(df, features)
    for piece in _pieces(trees, BROADCAST_NODES):
        flat = _packed(piece)
        used = np.unique(flat["feature"][flat["feature"] >= 0])
        if sparse:
            flat["feature"] = np.where(flat["feature"] < 0, -1, np.searchsorted(used, flat["feature"]))
        shared = df.sparkSession.sparkContext.broadcast(flat)

        def summed(x: np.ndarray, total: np.ndarray) -> np.ndarray:
            flat = shared.value
            for t in range(len(flat["start"])):
                for node in _walk(x, flat, t):
                    leaf = node
                total[:, flat["group"][t]] += flat["value"][leaf]
            return total

        @F.arrow_udf("array<double>")
        def of_maps(values: pa.Array, before: pa.Array) -> pa.Array:
            total = before.flatten().to_numpy(zero_copy_only=False).reshape(-1, k).copy()
            for start, x in _sparse_matrices(values, used):
                summed(x, total[start : start + len(x)])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * k), pa.array(total.ravel()))

        @F.pandas_udf("array<double>")
        def of_arrays(values: pd.Series, before: pd.Series) -> pd.Series:
            total = np.vstack(before.to_numpy()).astype(float) if len(before) else np.zeros((0, k))
            return pd.Series(list(summed(_matrix(values, width), total)))

        df = df.withColumn("__c", (of_maps if sparse else of_arrays)(features, F.array(*margins)))
        df = df.select(*[F.get("__c", F.lit(margins.index(c))).alias(c) if c in margins else F.col(c) for c in df.columns if c != "__c"])
    return df


def predict_trees(df: DataFrame, model: Model, features: str = "features", output: str = "prediction", margin: bool = False) -> DataFrame:
    """Adds the linked prediction (or the raw margin), using rounds up to the best one if it is known."""
    names = [f"__m_{i}" for i in range(model.n_outputs)]
    scored = add_margins(df, model, names, features, model.used_rounds)
    columns = [F.col(m) for m in names]
    value: Column = (columns[0] if len(columns) == 1 else F.array(*columns)) if margin else link(model.objective, columns)
    return scored.select(*df.columns, value.alias(output))


def predict_ensemble(df: DataFrame, models: Sequence[Model], features: str = "features", output: str = "prediction") -> DataFrame:
    """Adds what several models of one objective predict together: a vote for classes, else the mean, element by element.

    All models score the same row in one scan; nothing is shuffled. On ties of a vote the smallest class wins.
    """
    objectives = {m.objective for m in models}
    if len(objectives) != 1:
        raise ValueError(f"an ensemble needs models of one objective, not {sorted(objectives)}")
    names = [f"__member_{i}" for i in range(len(models))]
    scored = df
    for name, model in zip(names, models, strict=True):
        scored = predict_trees(scored, model, features, name)
    every = F.array(*names)
    if objectives <= set(VOTED):
        ranked = F.transform(F.array_distinct(every), lambda v: F.struct(F.size(F.filter(every, lambda o: o == v)).alias("n"), (-v).alias("v")))
        value = -F.array_max(ranked)["v"]
    elif scored.schema[names[0]].dataType.typeName() == "array":
        at = F.sequence(F.lit(0), F.size(names[0]) - 1)
        value = F.transform(at, lambda i: sum((F.get(n, i) for n in names), F.lit(0.0)) / len(models))
    else:
        value = sum((F.col(n) for n in names), F.lit(0.0)) / len(models)
    return scored.select(*df.columns, value.alias(output))


def predict_leaf(df: DataFrame, model: Model, features: str = "features", output: str = "leaves") -> DataFrame:
    """Adds the leaf id per tree as an array."""
    trees = model.used_trees()
    parts = []
    for number, piece in enumerate(_pieces(trees, 512)):
        nodes = [f"__l_{number}_{i}" for i in range(len(piece))]
        width = len(df.columns)
        df = routing.route(df, piece, nodes, False, features)
        df = df.select(*df.columns[:width], F.array(*nodes).alias(f"__leaf_{number}"))
        parts.append(f"__leaf_{number}")
    keep = [c for c in df.columns if c not in parts]
    return df.select(*keep, F.concat(*parts).alias(output))


def _path_shares(x: np.ndarray, flat: dict, tree: int, out: np.ndarray) -> None:
    """Adds to ``out`` (rows x features and bias) the change of node value at every step, credited to the split's feature."""
    rows, before = np.arange(len(x)), None
    for node in _walk(x, flat, tree):
        if before is None:
            out[:, -1] += flat["value"][node]
        else:
            out[rows, np.maximum(flat["feature"][before], 0)] += flat["value"][node] - flat["value"][before]
        before = node


def _leaf_paths(flat: dict, tree: int) -> Iterator[tuple[float, dict[int, tuple[float, tuple]]]]:
    """Value of each leaf, and per feature of its path the share of the cover that follows it and the splits it asks."""
    todo: list[tuple[int, dict]] = [(int(flat["start"][tree]), {})]
    while todo:
        node, path = todo.pop()
        feature = int(flat["feature"][node])
        if feature < 0:
            yield float(flat["value"][node]), path
            continue
        left, right = int(flat["left"][node]), int(flat["right"][node])
        cover = flat["cover"][left] + flat["cover"][right]
        share, asked = path.get(feature, (1.0, ()))
        for child, goes_left in ((left, True), (right, False)):
            part = float(flat["cover"][child] / cover) if cover > 0 else 0.5
            todo.append((child, {**path, feature: (share * part, (*asked, (node, goes_left)))}))


def _subset_weights(known: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1, for rows of ``known`` (1 where the row follows the feature's splits, else 0).

    A subset S of the other d - 1 features counts |S|! (d - 1 - |S|)! / d!, which is the integral of
    t^|S| (1 - t)^(d - 1 - |S|) over 0..1. So the sum over all subsets is the integral of one product with a factor per
    feature, a polynomial that Gauss-Legendre points integrate exactly.
    """
    d = len(shares)
    points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    t = (points + 1) / 2
    factors = shares[None, :, None] * (1 - t) + known[:, :, None] * t
    before, after = np.ones_like(factors), np.ones_like(factors)
    np.cumprod(factors[:, :-1], axis=1, out=before[:, 1:])
    after[:, :-1] = np.cumprod(factors[:, :0:-1], axis=1)[:, ::-1]
    return (known - shares) * (before * after * (weights / 2)).sum(axis=2)


def _shapley_shares(x: np.ndarray, flat: dict, tree: int, out: np.ndarray) -> None:
    """Adds to ``out`` (rows x features and bias) the Shapley values of one tree.

    A feature that isn't known sends a row both ways, by cover. Rows that follow the same features of a leaf's path share
    one computation.
    """
    for value, path in _leaf_paths(flat, tree):
        shares = np.array([share for share, _ in path.values()])
        out[:, -1] += value * shares.prod()
        if not path:
            continue
        follows = np.ones((len(x), len(path)), dtype=bool)
        for j, (feature, (_, asked)) in enumerate(path.items()):
            v = x[:, feature]
            missing = np.isnan(v)
            for node, goes_left in asked:
                follows[:, j] &= np.where(missing, flat["default_left"][node], v < flat["split"][node]) == goes_left
        patterns, number = np.unique(np.packbits(follows, axis=1), axis=0, return_inverse=True)
        known = np.unpackbits(patterns, axis=1, count=len(path)).astype(float)
        out[:, list(path)] += (value * _subset_weights(known, shares))[number.ravel()]


def predict_contribs(df: DataFrame, model: Model, features: str = "features", output: str = "contribs", method: str = "shapley") -> DataFrame:
    """Adds per-feature contributions and the bias (last entry); they add up to the margin.

    ``shapley``: path-dependent Shapley values, with the covers of the nodes as weights of features that aren't known; the
    bias is the mean of the leaves by cover. ``path``: each step down a tree credits the change of node value to the
    feature of the split. Class-major order for several outputs.
    """
    if routing.is_sparse(df, features):
        raise ValueError("contributions have one entry per feature: make the map of features an array first (dense_features)")
    if method not in ("shapley", "path"):
        raise ValueError(f"contributions are by shapley or path, not {method}")
    if method == "shapley" and any(t.feature[0] >= 0 and not t.cover[0] > 0 for t in model.used_trees()):
        raise ValueError("Shapley values need the covers of nodes, which this model lacks (refresh_trees finds them)")
    shares = _shapley_shares if method == "shapley" else _path_shares
    k, width, base = model.n_outputs, model.n_features, model.base_margin
    shape = k * (width + 1)
    df = df.withColumn(output, F.array_repeat(F.lit(0.0), shape))
    for number, piece in enumerate(_pieces(model.used_trees(), BROADCAST_NODES)):
        shared = df.sparkSession.sparkContext.broadcast(_packed(piece))
        start = base if number == 0 else 0.0

        @F.pandas_udf("array<double>")
        def credit(values: pd.Series) -> pd.Series:
            flat, x = shared.value, _matrix(values, width)
            out = np.zeros((len(x), k, width + 1))
            out[:, :, width] = start
            for t in range(len(flat["start"])):
                shares(x, flat, t, out[:, flat["group"][t]])
            return pd.Series(list(out.reshape(len(x), shape)))

        df = df.withColumn(output, F.zip_with(output, credit(features), lambda a, b: a + b))
    return df
