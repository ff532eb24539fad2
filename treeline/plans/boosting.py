"""Boosting: a driver loop over rounds and levels; rows never leave the executors.

Each level is one aggregate (gradient histogram) and one small collect (the best split per node). Rows are
moved through the growing tree by literal lookups, so no row is shuffled after it is read. Rows live in a
frame that is persisted anew each round and written to the shared folder every few rounds.
"""

from __future__ import annotations

import dataclasses
import heapq
import math
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeline.operators import gradients as G
from treeline.operators import histograms as H
from treeline.operators import routing
from treeline.operators.checks import label_rules
from treeline.operators.confusion import metric_names, tuning_metrics
from treeline.operators.evaluation import is_maximize, is_pointwise, mean_aggregate
from treeline.operators.group_gradients import Layout, group_gradients, layout
from treeline.operators.ranking import event_time
from treeline.operators.metric_by_name import evaluate_named
from treeline.operators.sketches import weighted_feature_bins, weighted_medians
from treeline.operators.routing import Tree
from treeline.operators.sampling import choose_features, gradient_size, keep_probability, keep_row
from treeline.functions.hashing import hash_unit, local_hash_int
from treeline.plans.model import Model
from treeline.plans.parameters import resolve_parameters
from treeline.session import remove_path, scratch_path

CARRIED = ("row_id", "group_id", "label_lower", "label_upper", "fold")
REFRESH_ROUNDS = 5
# metrics that, named by the user, the log takes without row weights
UNWEIGHTED = ("mae", "rmse", "mse")
ROUND_SEED = 1_000_003  # between the seeds of two rounds
HISTOGRAM_BITS = 62
KEPT_STEPS = 8  # levels a row is routed through again before its nodes are stored with it
SUBTRACT_CELLS = 200_000_000
SMALL_CELLS = 50_000_000
ROWS_PER_PART = 500_000  # of rows that are dealt by their group


class Rows:
    """Binned training rows with their current margins, persisted anew every round.

    The frame of a round is computed from that of the round before. Every few rounds it is also written to the
    shared folder and read back, so that lost executors recompute a few rounds at most.
    """

    def __init__(self, df: DataFrame, margins: list[str], key: str | None = None, parts: int = 0):
        # with a key, the rows that depend on each other lie in one partition, and rounds don't shuffle them
        self.margins, self.key, self.parts = margins, key, parts
        self.df = self._held(df.repartition(parts, key) if key else df)
        self.old: DataFrame | None = None
        self.age = 0
        self._slots = [scratch_path(df.sparkSession, "rows") for _ in range(2)]
        self._turn = 0

    def _held(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        if self.key:
            df.count()  # plans made before a frame is there don't know how its rows are dealt
        return df

    def advance(self, df: DataFrame, last: bool = False) -> None:
        """Takes the frame with updated margins; it is computed by the next pass over the rows."""
        self.settle()
        self.age += 1
        if self.age >= REFRESH_ROUNDS and not last:
            path = self._slots[self._turn % 2]
            self._turn, self.age = self._turn + 1, 0
            df.write.mode("overwrite").parquet(path)
            df = df.sparkSession.read.schema(df.schema).parquet(path)
            df = df.repartition(self.parts, self.key) if self.key else df
        self.old, self.df = self.df, self._held(df)

    def settle(self) -> None:
        """Releases the frame of the round before; called once the current one has been computed."""
        if self.old is not None:
            self.old.unpersist()
            self.old = None

    def close(self) -> None:
        self.settle()
        self.df.unpersist()


def plain_rows(df: DataFrame, margins: list[str], base: float | None, params: dict) -> DataFrame:
    """``carried, label, w, features`` from ``label, features[, weight]``, with ``m_*`` where a base is given."""
    y = F.col("label").cast("double")
    w = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    if float(params["scale_pos_weight"]) != 1.0:
        w = G.scale_positive_weight(y, w, params["scale_pos_weight"])
    carried = [c for c in CARRIED if c in df.columns]
    kind = "map<int,double>" if routing.is_sparse(df, "features") else "array<double>"
    df = df.select(*carried, y.alias("label"), w.alias("w"), F.col("features").cast(kind).alias("features"))
    return df if base is None else df.select("*", *[F.lit(float(base)).alias(m) for m in margins])


def _prepare(df: DataFrame, cuts, margins: list[str], base: float, objective: str, params: dict, start: Model | None) -> DataFrame:
    """``carried, label, w, bins, m_*`` from ``label, features[, weight]``."""
    df = plain_rows(df, margins, base if start is None else None, params)
    if start is not None:
        from treeline.plans.scoring import add_margins

        df = add_margins(df, start, margins)
    return H.bin_features(df, cuts)


def _cut_points(df: DataFrame, n_features: int, max_bin: int) -> list[list[float]]:
    """Cut points on the driver: part of the model, at most features x max_bin numbers. Row weights count, if given."""
    cuts: list[list[float]] = [[] for _ in range(n_features)]
    found = weighted_feature_bins(df, max_bin) if "weight" in df.columns else H.feature_bins(df, max_bin)
    for row in found.collect():
        cuts[row["feature"]] = list(row["cuts"])
    return cuts


class Grower:
    """Grows the trees of one round on a frame with ``bins, g_k, h_k`` and node columns."""

    def __init__(self, params: dict, cuts, n_classes: int, round_number: int, bits: int | None, cells: int, sparse: bool = False):
        self.p, self.cuts, self.k, self.round, self.bits, self.sparse = params, cuts, n_classes, round_number, bits, sparse
        self.subtract = cells >= SUBTRACT_CELLS and bits is not None  # exact on whole numbers only
        self.parallel = int(params["num_parallel_tree"])
        self.trees = [Tree(group=t % n_classes) for t in range(n_classes * self.parallel)]
        self.nodes = [f"n_{t}" for t in range(len(self.trees))]
        self.frames: dict[tuple[int, int], DataFrame] = {}
        self.kept: list[DataFrame] = []
        self.stored: list[str] = []  # folders of rows with their nodes
        self.steps = 0
        monotone = params.get("monotone_constraints")
        self.monotone = list(monotone) + [0] * (len(cuts) - len(monotone)) if monotone else None
        self.groups = [frozenset(g) for g in params.get("interaction_constraints") or []]

    # -- which features a node may split on
    def allowed(self, t: int, node: int) -> list[int]:
        p, tree = self.p, self.trees[t]
        seed = p["seed"]
        base = choose_features(list(range(len(self.cuts))), p["colsample_bytree"], seed, self.round, t, "-", "-")
        level = choose_features(base, p["colsample_bylevel"], seed, self.round, t, tree.depth[node], "-")
        chosen = choose_features(level, p["colsample_bynode"], seed, self.round, t, tree.depth[node], node)
        if self.groups and tree.path[node]:
            reachable = set().union(*[g for g in self.groups if tree.path[node] <= g], tree.path[node])
            chosen = [f for f in chosen if f in reachable]
        return chosen

    def candidate(self, frontier) -> str | None:
        per_node = {key: tuple(self.allowed(*key)) for key in frontier}
        distinct = set(per_node.values())
        if distinct == {tuple(range(len(self.cuts)))}:
            return None
        if len(distinct) == 1:
            return f"feature IN ({','.join(map(str, distinct.pop()))})"
        return " OR ".join(
            f"(tree = {t} AND node = {n} AND feature IN ({','.join(map(str, features))}))" for (t, n), features in per_node.items()
        )

    def bounds(self, frontier):
        if self.monotone is None:
            return None, None
        def limit(side: str) -> str:
            cases = " ".join(f"WHEN tree = {t} AND node = {n} THEN {routing.number_sql(getattr(self.trees[t], side)[n])}" for t, n in frontier)
            return f"(CASE {cases} END)"

        return (limit("low"), limit("high")), f"get({routing.literal_array(self.monotone)}, feature)"

    # -- histogram of some nodes
    def count(self, df: DataFrame, build) -> DataFrame:
        by_tree: dict[int, list[int]] = {}
        for t, n in build:
            by_tree.setdefault(t, []).append(n)
        members = []
        for t, nodes in by_tree.items():
            wanted = F.col(f"n_{t}").isin(nodes)
            if "s_0" in df.columns:
                wanted = wanted & F.col(f"s_{t // self.k}")
            members.append(([F.lit(t), F.col(f"n_{t}")], F.col(f"g_{t % self.k}"), F.col(f"h_{t % self.k}"), wanted))
        return H.count_cells(df, members, ("tree", "node"), bits=self.bits)

    def histogram(self, df: DataFrame, frontier, pairs) -> DataFrame:
        """Histograms of the frontier. On large inputs only the roots and smaller children are counted and the
        larger children come from their parent by subtraction; on small ones a second shuffle costs more."""
        if pairs is None or not self.subtract:
            hist = self.count(df, frontier)
            if not self.subtract and not self.sparse:
                return hist
        else:
            built = self.count(df, [s for s, _, _ in pairs])
            parents = {id(self.frames[p]): self.frames[p] for _, _, p in pairs}
            parent_hist = None
            for frame in parents.values():
                parent_hist = frame if parent_hist is None else parent_hist.unionByName(frame)
            entries = ",".join(f"'{t}_{n}',{big[1]}" for (s, big, parent) in pairs for (t, n) in (s, parent))
            family = f"try_element_at(map({entries}), concat_ws('_', tree, node))"
            hist = built.unionByName(H.subtract_sibling(parent_hist, built, family))
        hist = hist.persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.append(hist)
        for key in frontier:
            self.frames[key] = hist
        return hist

    def split(self, df: DataFrame, frontier, pairs) -> list:
        bounds, direction = self.bounds(frontier)
        found = H.best_split(
            self.histogram(df, frontier, pairs), self.p, bits=self.bits,
            candidate=self.candidate(frontier), bounds=bounds, direction=direction, sparse=self.sparse,
        )
        return found.collect()

    def apply(self, row) -> list[tuple]:
        """Writes one split into its tree; returns (smaller child, larger child, parent)."""
        t, n = row["tree"], row["node"]
        tree = self.trees[t]
        f, b = row["feature"], row["bin"]
        left, right = tree.add_children(n)
        tree.feature[n], tree.bin[n], tree.default_left[n] = f, b, bool(row["default_left"])
        tree.split[n] = self.cuts[f][b - 1] if b - 1 < len(self.cuts[f]) else float("inf")
        tree.gain[n] = row["gain"]
        eta = float(self.p["eta"]) / self.parallel
        for child, w, h in ((left, row["wl"], row["hl"]), (right, row["wr"], row["hr"])):
            tree.value[child], tree.cover[child] = w * eta, h
            tree.path[child] = tree.path[n] | {f}
        if self.monotone and self.monotone[f]:
            mid = (row["wl"] + row["wr"]) / 2
            lower, upper = (left, right) if self.monotone[f] > 0 else (right, left)
            tree.high[lower], tree.low[upper] = mid, mid
        small, big = ((t, left), (t, right)) if row["nl"] <= row["nr"] else ((t, right), (t, left))
        return [small, big, (t, n)]

    def root_values(self, rows) -> None:
        eta = float(self.p["eta"]) / self.parallel
        for row in rows:
            tree = self.trees[row["tree"]]
            tree.value[0], tree.cover[0] = row["weight"] * eta, row["h"]

    def grow(self, df: DataFrame) -> DataFrame:
        df = df.select("*", *[F.lit(0).alias(n) for n in self.nodes])
        out = self._by_loss(df) if self.p["grow_policy"] == "lossguide" else self._by_depth(df)
        return out

    def step(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        return routing.step_all(df, self.trees, self.nodes, True, "bins")

    def store(self, df: DataFrame) -> DataFrame:
        """Every few levels the rows are written with their nodes, so that deep trees don't start from the root again
        and plans stay small. Folders last until the trees are finished: what is recomputed reads what was read before."""
        if self.steps < KEPT_STEPS:
            return df
        self.steps = 0
        self.stored.append(scratch_path(df.sparkSession, "nodes"))
        df.write.parquet(self.stored[-1])
        return df.sparkSession.read.schema(df.schema).parquet(self.stored[-1])

    def finish(self, spark: SparkSession) -> None:
        for hist in self.kept:
            hist.unpersist()
        for path in self.stored:
            remove_path(spark, path)

    def _by_depth(self, df: DataFrame) -> DataFrame:
        limit = int(self.p["max_depth"]) or 10**9
        leaves_left = (int(self.p["max_leaves"]) or 10**9) - 1
        budget = {t: leaves_left for t in range(len(self.trees))}
        frontier, pairs, depth = [(t, 0) for t in range(len(self.trees))], None, 0
        while frontier and depth < limit:
            df = self.store(df)
            rows = self.split(df, frontier, pairs)
            if depth == 0:
                self.root_values(rows)
            pairs = []
            for row in sorted((r for r in rows if r["gain"] is not None), key=lambda r: (-r["gain"], r["tree"], r["node"])):
                if budget[row["tree"]] > 0:
                    budget[row["tree"]] -= 1
                    pairs.append(self.apply(row))
            if not pairs:
                break
            df = self.step(df)
            frontier = [key for s, b, _ in pairs for key in (s, b)]
            depth += 1
        return df

    def _by_loss(self, df: DataFrame) -> DataFrame:
        limit = int(self.p["max_depth"]) or 10**9
        budget = {t: (int(self.p["max_leaves"]) or 10**9) - 1 for t in range(len(self.trees))}
        heap: list = []

        def push(rows):
            for r in rows:
                if r["gain"] is not None:
                    heapq.heappush(heap, (-r["gain"], r["tree"], r["node"], r))

        rows = self.split(df, [(t, 0) for t in range(len(self.trees))], None)
        self.root_values(rows)
        push(rows)
        while heap:
            _, t, n, row = heapq.heappop(heap)
            if budget[t] <= 0:
                continue
            budget[t] -= 1
            pair = self.apply(row)
            df = self.step(df)
            if self.trees[t].depth[pair[0][1]] < limit and budget[t] > 0:
                df = self.store(df)
                push(self.split(df, [pair[0], pair[1]], [pair]))
        return df


def _refit_to_median(df: DataFrame, grower: Grower, margins: list[str], eta: float) -> None:
    """Leaf values of the absolute-error objective: the weighted median residual of each leaf."""
    for t, tree in enumerate(grower.trees):
        residual = F.col("label") - F.col(margins[tree.group])
        long = df.select(F.col(f"n_{t}").alias("feature"), residual.alias("value"), "w").where("value IS NOT NULL AND feature IS NOT NULL")
        for row in weighted_medians(long).collect():  # one row per leaf
            tree.value[row["feature"]] = row["median"] * eta / grower.parallel


def _dropped(params: dict, model: Model, round_number: int) -> list[tuple[int, int]]:
    """Trees left out of the margin while a new one is grown (choice depends on tree numbers only)."""
    if params["booster"] != "dart" or not model.trees:
        return []
    seed = params["seed"]

    def unit(*parts):
        return local_hash_int(seed, round_number, *parts) / 2**32

    if unit("skip") < float(params["skip_drop"]):
        return []
    every = [(r, i) for r, trees in enumerate(model.trees) for i in range(len(trees))]
    scales = [model.trees[r][i].scale for r, i in every]
    rate, mean = float(params["rate_drop"]), sum(scales) / len(scales)
    picked = []
    for (r, i), s in zip(every, scales):
        chance = rate * s / mean if params["sample_type"] == "weighted" and mean > 0 else rate
        if unit("drop", r, i) < chance:
            picked.append((r, i))
    if not picked and int(params["one_drop"]):
        picked = [min(every, key=lambda k: unit("one", *k))]
    return picked


def _tree_contributions(df: DataFrame, trees: list[Tree], margins: list[str], factor: float) -> DataFrame:
    nodes = [f"d_{i}" for i in range(len(trees))]
    return routing.add_tree_values(routing.route(df, trees, nodes, True, "bins"), trees, nodes, margins, factor)


def fit_boosted_trees(
    df: DataFrame,
    params: dict,
    validation: DataFrame | None = None,
    start: Model | None = None,
    watch: dict[str, DataFrame] | None = None,
    fold: int = 0,
    on_round: Callable[[Model, int], None] | None = None,
) -> Model:
    """Trains on ``label, features[, weight, row_id, group_id, label_lower, label_upper]``.

    Every round each data set (train, validation, others in ``watch``) is evaluated with every metric.
    ``features`` is an array, or a map from index to value whose absent indices are missing values: then work and
    memory follow the entries that are there, not the largest index. ``start`` continues a model; ``on_round`` is
    called after each round (for saving). With ``process_type=update`` the
    trees of ``start`` are refreshed or pruned instead, and none is grown.
    """
    p = resolve_parameters(params)
    objective = p["objective"]
    if p["booster"] == "gblinear":
        raise ValueError("booster gblinear is trained by fit_linear")
    k = int(p["num_class"]) if G.is_multiclass(objective) else 1
    margins = [f"m_{i}" for i in range(k)]
    sparse = routing.is_sparse(df, "features")
    source = None
    if objective in G.GROUP_OBJECTIVES and p["process_type"] != "update" and not (df.storageLevel.useMemory or df.storageLevel.useDisk):
        # these rows are measured and dealt by their groups before training: they are read or joined once for all of it
        source = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(df, p, objective, k, margins, sparse, validation, start, watch, fold, on_round, source)
    finally:
        if source is not None:
            source.unpersist()


def _fit(df: DataFrame, p: dict, objective: str, k: int, margins: list[str], sparse: bool, validation, start, watch, fold: int, on_round, source) -> Model:
    rules = label_rules(objective, p.get("num_class"))
    widths = [F.max(F.array_max(F.map_keys("features")) + 1), F.min(F.array_min(F.map_keys("features")))] if sparse else [F.max(F.size("features")), F.lit(0)]
    shape = df.agg(
        widths[0].alias("width"), widths[1].alias("least"), F.sum(F.greatest(F.size("features"), F.lit(0))).alias("cells"), F.count("label").alias("n"), F.count(F.lit(1)).alias("rows"), *[c.alias(f"r{i}") for i, c in enumerate(rules.values())]
    ).first()
    if not shape["n"]:
        raise ValueError("input data has no labels")
    for i, rule in enumerate(rules):
        if shape[f"r{i}"]:
            raise ValueError(f"{rule} ({shape[f'r{i}']} rows)")
    if (shape["least"] or 0) < 0 or (shape["width"] or 0) > routing.MAX_FEATURES:
        raise ValueError(f"feature indices must be from 0 to {routing.MAX_FEATURES - 1}")
    if int(p["max_bin"]) >= 1 << routing.BIN_BITS:
        raise ValueError(f"max_bin must be below {1 << routing.BIN_BITS}")
    if p["process_type"] == "update":
        return _update(df, p, validation, start, watch, fold, on_round)
    if p.get("save_model_on_termination") == "true" and on_round is None:
        raise ValueError("save_model_on_termination needs a place for the model: resume_fit saves every round")
    n_features = start.n_features if start else shape["width"] or 0
    if start is not None:
        base = start.base_margin
    else:
        given = p.get("base_score")
        base = G.base_margin(objective, float(given) if given is not None else G.default_base(objective))
    model = Model(objective, p, base, n_features, k)
    if start is not None:
        model.trees, model.log = [list(r) for r in start.trees], list(start.log)
    total_rounds = int(p["num_round"])
    if len(model.trees) >= total_rounds:
        return model

    known = None
    if objective in G.GROUP_OBJECTIVES and (objective == "survival:cox" or {"row_id", "group_id"} <= set(df.columns)):
        known = layout(df, objective)
    if not (known and known.key) and (shape["cells"] or 0) <= SMALL_CELLS:
        # few files can mean fewer partitions than cores; large inputs keep the partitions of their scan
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    cuts = _cut_points(df, n_features, max(2, int(p["max_bin"]) or 256))
    if p["booster"] == "dart":
        _bin_splits(model, cuts)
    prepared = _prepare(df, cuts, margins, base, objective, p, start)
    if known and known.key:
        prepared = prepared.withColumn("time", event_time(prepared)) if objective == "survival:cox" else prepared
        train = Rows(prepared, margins, known.key, max(df.sparkSession.sparkContext.defaultParallelism, shape["rows"] // ROWS_PER_PART))
    else:
        train = Rows(prepared, margins)
    sets = {"train": train}
    for name, frame in {**({"validation": validation} if validation is not None else {}), **(watch or {})}.items():
        sets[name] = Rows(_prepare(frame, cuts, margins, base, objective, p, start), margins)
    named = metric_names(p.get("_tuning_objective_metric"), p.get("eval_metric"))
    metrics = named or [default_metric(objective)]
    # stopping looks at the last tuning metric, else the last metric named by the user, on the validation data
    stop_metric = (tuning_metrics(p.get("_tuning_objective_metric")) or p.get("eval_metric") or [None])[-1]
    patience = p.get("early_stopping_rounds") if stop_metric and validation is not None else None
    best, held = None, None
    if patience and start is not None:  # the best round before a restart
        seen = [(value, last) for last, f, name, m, value in model.log if (f, name, m) == (fold, "validation", stop_metric)]
        best = (max if is_maximize(stop_metric) else min)(seen, key=lambda x: x[0], default=None)

    for round_number in range(len(model.trees), total_rounds + 1):
        done = round_number > 0 and model.trees and len(model.trees) == round_number and round_number > (len(start.trees) if start else 0)
        wanted = metrics if done else []
        if round_number == total_rounds:
            values = evaluate_margins(train.df, objective, wanted, p, margins, known)
        else:
            grad = row_gradients(train.df, objective, p, margins, round_number, known)
            held = grad.persist(StorageLevel.MEMORY_AND_DISK) if objective in G.GROUP_OBJECTIVES else None
            stats, values = _stats_and_metrics(train, grad, objective, wanted, p, margins, known)
        if source is not None:
            source.unpersist()  # the rows stand in their own frame now
        train.settle()
        if done:
            last = round_number - 1
            logged = {}
            for name, rows in sets.items():
                scores = values if name == "train" else evaluate_margins(rows.df, objective, metrics, p, margins)
                for m, v in zip(metrics, scores):
                    model.log.append((last, fold, name, m, v))
                logged[name] = scores
            if patience:
                score = logged["validation"][metrics.index(stop_metric)]
                if best is None or (score > best[0] if is_maximize(stop_metric) else score < best[0]):
                    best = (score, last)
                model.best_round = best[1]
                if last - best[1] >= int(patience):
                    break
            if on_round:
                on_round(model, last)
        if round_number == total_rounds:
            break
        dropped = _dropped(p, model, round_number)
        if dropped:
            out = [model.trees[r][i] for r, i in dropped]
            grad = row_gradients(_tree_contributions(train.df, out, margins, -1.0), objective, p, margins, round_number, known)
            stats, _ = _stats_and_metrics(train, grad, objective, [], p, margins)
        grad = _sample(grad, p, round_number, stats, k)
        bits = _fixed_point_bits(stats) if p["deterministic_histogram"] == "true" else None
        grower = Grower(p, cuts, k, round_number, bits, (shape["cells"] or 0) + stats["rows"] if sparse else stats["rows"] * len(cuts), sparse)
        grown = grower.grow(grad)
        if objective == "reg:absoluteerror":
            _refit_to_median(grown, grower, margins, float(p["eta"]))
        _dart_weights(p, model, dropped, grower.trees)
        model.trees.append(grower.trees)
        for rows in sets.values():
            nodes = [f"u_{t}" for t in range(len(grower.trees))]
            updated = rows.df
            if dropped:
                out = [model.trees[r][i] for r, i in dropped]
                shrink = _shrink(p, len(dropped))
                updated = _tree_contributions(updated, out, margins, -(1.0 - shrink) / shrink)
            updated = routing.route(updated, grower.trees, nodes, True, "bins")
            rows.advance(routing.add_tree_values(updated, grower.trees, nodes, margins), last=round_number == total_rounds - 1)
        grower.finish(df.sparkSession)
        if held is not None:
            held.unpersist()
            held = None
    if held is not None:
        held.unpersist()
    if known and known.hot is not None:
        known.hot.unpersist()
    for rows in sets.values():
        rows.close()
    return model


def _update(df: DataFrame, p: dict, validation, start: Model | None, watch, fold: int, on_round) -> Model:
    """Updated trees of ``start``, with the metrics of every round on every data set."""
    from treeline.plans.refresh import update_trees

    if start is None:
        raise ValueError("process_type update needs a model to start from")
    if p.get("early_stopping_rounds"):
        raise ValueError("early_stopping_rounds is not available with process_type update")
    model = update_trees(df, start, p)
    margins = [f"m_{i}" for i in range(model.n_outputs)]
    metrics = metric_names(p.get("_tuning_objective_metric"), p.get("eval_metric")) or [default_metric(model.objective)]
    sets = {"train": df, **({"validation": validation} if validation is not None else {}), **(watch or {})}
    rows = {name: Rows(plain_rows(frame, margins, model.base_margin, p), margins) for name, frame in sets.items()}
    for number, trees in enumerate(model.trees):
        nodes = [f"u_{t}" for t in range(len(trees))]
        for name, held in rows.items():
            held.advance(routing.add_tree_values(routing.route(held.df, trees, nodes, False, "features"), trees, nodes, margins), last=number == len(model.trees) - 1)
            model.log += [(number, fold, name, m, v) for m, v in zip(metrics, evaluate_margins(held.df, model.objective, metrics, p, margins))]
            held.settle()
        if on_round:
            on_round(dataclasses.replace(model, trees=model.trees[: number + 1], log=list(model.log)), number)
    for held in rows.values():
        held.close()
    return model


def _bin_splits(model: Model, cuts) -> None:
    """Bin numbers of a continued model's splits, exact where its split values are among the cuts."""
    import bisect

    for trees in model.trees:
        for t in trees:
            t.bin = [bisect.bisect_left(cuts[f], s) + 1 if f >= 0 else 0 for f, s in zip(t.feature, t.split)]


def default_metric(objective: str) -> str:
    named = {
        "binary:logistic": "logloss", "reg:logistic": "rmse", "binary:logitraw": "logloss", "binary:hinge": "error",
        "multi:softmax": "merror", "multi:softprob": "mlogloss", "count:poisson": "poisson-nloglik",
        "reg:gamma": "gamma-nloglik", "reg:tweedie": "tweedie-nloglik", "reg:squaredlogerror": "rmsle",
        "reg:pseudohubererror": "mphe", "reg:absoluteerror": "mae", "rank:pairwise": "map", "rank:ndcg": "ndcg",
        "rank:map": "map", "survival:cox": "cox-nloglik", "survival:aft": "aft-nloglik",
    }
    return named.get(objective, "rmse")


def row_gradients(df: DataFrame, objective: str, p: dict, margins: list[str], round_number: int, known: Layout | None = None) -> DataFrame:
    if objective in G.GROUP_OBJECTIVES:
        # pairs are drawn anew every round
        return group_gradients(df, objective, {**p, "seed": int(p["seed"]) + ROUND_SEED * round_number}, known)
    return G.gradient_pairs(df, objective, {**p, "scale_pos_weight": 1.0}, weight="w", margins=tuple(margins))


def _prediction(objective: str, margins: list[str], metric: str) -> Column:
    """What a metric compares with the label: classes, class probabilities or the linked value."""
    columns = [F.col(m) for m in margins]
    if G.is_multiclass(objective) and metric in ("mlogloss", "merror"):
        return G.link("multi:softprob", columns)
    if objective == "binary:logitraw" and metric in ("logloss", "error"):
        return G.link("binary:logistic", columns)
    return G.link(objective, columns)


def _metric_weight(metric: str, p: dict) -> Column:
    named = metric_names(p.get("_tuning_objective_metric"), p.get("eval_metric"))
    return F.lit(1.0) if metric in UNWEIGHTED and metric in (named or ()) else F.col("w")


def _stats_and_metrics(rows: Rows, grad: DataFrame, objective: str, metrics: Sequence[str], p: dict, margins: list[str], known: Layout | None = None):
    """Gradient totals and all per-row metrics of the current margins, in one pass."""
    k = len(margins)
    size = sum((gradient_size(F.col(f"g_{i}"), F.col(f"h_{i}"), float(p["lambda"])) for i in range(k)), F.lit(0.0))
    aggregates = [F.count(F.lit(1)).alias("rows"), F.sum(size).alias("size")]
    aggregates += [F.sum(F.abs(F.col(f"g_{i}"))).alias(f"g{i}") for i in range(k)]
    aggregates += [F.sum(F.col(f"h_{i}")).alias(f"h{i}") for i in range(k)]
    for i, m in enumerate(metrics):
        if is_pointwise(m):
            aggregates.append(mean_aggregate(m, F.col("label"), _prediction(objective, margins, m), _metric_weight(m, p), p).alias(f"v{i}"))
    row = grad.agg(*aggregates).first()
    values = []
    for i, m in enumerate(metrics):
        values.append(row[f"v{i}"] if is_pointwise(m) else evaluate_named(rows.df, m, objective, margins, p, known.bounds if known else None))
    stats = {"rows": row["rows"], "size": row["size"] or 0.0, "top": max([row[f"g{i}"] or 0.0 for i in range(k)] + [row[f"h{i}"] or 0.0 for i in range(k)])}
    return stats, values


def evaluate_margins(df: DataFrame, objective: str, metrics: Sequence[str], p: dict, margins: list[str], known: Layout | None = None) -> list[float]:
    """Values of ``metrics`` on ``label, w`` and the margin columns; all per-row metrics in one pass."""
    simple = [m for m in metrics if is_pointwise(m)]
    found = {}
    if simple:
        row = df.agg(*[
            mean_aggregate(m, F.col("label"), _prediction(objective, margins, m), _metric_weight(m, p), p).alias(f"v{i}") for i, m in enumerate(simple)
        ]).first()
        found = {m: row[f"v{i}"] for i, m in enumerate(simple)}
    return [found[m] if m in found else evaluate_named(df, m, objective, margins, p, known.bounds if known else None) for m in metrics]


def _fixed_point_bits(stats: dict) -> int:
    """Most binary places for which no sum can overflow 64 bits."""
    top = max(1.0, stats["top"] + stats["rows"] * 2.0**-20)
    return max(0, min(40, HISTOGRAM_BITS - math.ceil(math.log2(top)) - 1))


def _sample(grad: DataFrame, p: dict, round_number: int, stats: dict, k: int) -> DataFrame:
    fraction = float(p["subsample"])
    if fraction >= 1.0:
        return grad
    if "row_id" not in grad.columns:
        raise ValueError("subsample needs a row_id column")
    seed, row = p["seed"], F.col("row_id")
    parallel = int(p["num_parallel_tree"])
    if p["sampling_method"] == "uniform":
        return grad.select("*", *[keep_row(seed, round_number, row, fraction, t).alias(f"s_{t}") for t in range(parallel)])
    size = sum((gradient_size(F.col(f"g_{i}"), F.col(f"h_{i}"), float(p["lambda"])) for i in range(k)), F.lit(0.0))
    grad = grad.withColumn("__q", keep_probability(size, stats["size"], stats["rows"], fraction))
    kept = [(hash_unit(seed, round_number, t, row) < F.col("__q")).alias(f"s_{t}") for t in range(parallel)]
    grad = grad.select("*", *kept)
    weighted = {f"{c}_{i}": F.col(f"{c}_{i}") / F.col("__q") for c in "gh" for i in range(k)}
    return grad.withColumns(weighted).drop("__q")


def _shrink(p: dict, n_dropped: int) -> float:
    eta = float(p["eta"])
    return 1.0 / (1.0 + eta) if p["normalize_type"] == "forest" else n_dropped / (n_dropped + eta)


def _dart_weights(p: dict, model: Model, dropped, new_trees: list[Tree]) -> None:
    """Scales dropped and new trees so that together they replace what was dropped."""
    if not dropped:
        return
    eta, n = float(p["eta"]), len(dropped)
    factor = _shrink(p, n)
    for r, i in dropped:
        model.trees[r][i].scale *= factor
    for t in new_trees:
        t.scale = 1.0 / (1.0 + eta) if p["normalize_type"] == "forest" else 1.0 / (n + eta)
