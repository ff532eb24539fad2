"""Training parameters: names, kinds, bounds, aliases, and the checks between them."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from treeline.operators.evaluation import MAXIMIZE, MINIMIZE

# Name, kind, lower bound, lower open, upper bound, upper open, allowed words.
RULES: list[tuple] = [
    ("num_round", "int", 1, False, None, False, None),
    ("csv_weights", "int", 0, False, 1, False, None),
    ("early_stopping_rounds", "int", 1, False, None, False, None),
    ("booster", "word", None, False, None, False, "gbtree,gblinear,dart"),
    ("verbosity", "int", 0, False, 3, False, None),
    ("nthread", "int", 1, False, None, False, None),
    ("eta", "float", 0, False, 1, False, None),
    ("gamma", "float", 0, False, None, False, None),
    ("max_depth", "int", 0, False, None, False, None),
    ("min_child_weight", "float", 0, False, None, False, None),
    ("max_delta_step", "float", 0, False, None, False, None),
    ("subsample", "float", 0, True, 1, False, None),
    ("colsample_bytree", "float", 0, True, 1, False, None),
    ("colsample_bylevel", "float", 0, True, 1, False, None),
    ("colsample_bynode", "float", 0, True, 1, False, None),
    ("lambda", "float", 0, False, None, False, None),
    ("alpha", "float", 0, False, None, False, None),
    ("tree_method", "word", None, False, None, False, "auto,exact,approx,hist,gpu_hist"),
    ("sketch_eps", "float", 0, True, 1, True, None),
    ("scale_pos_weight", "float", 0, True, None, False, None),
    ("updater", "words", None, False, None, False, "grow_colmaker,distcol,grow_histmaker,grow_skmaker,sync,refresh,prune,shotgun,coord_descent"),
    ("dsplit", "word", None, False, None, False, "row,col"),
    ("refresh_leaf", "int", 0, False, 1, False, None),
    ("process_type", "word", None, False, None, False, "default,update"),
    ("grow_policy", "word", None, False, None, False, "depthwise,lossguide"),
    ("max_leaves", "int", 0, False, None, False, None),
    ("max_bin", "int", 0, False, None, False, None),
    ("predictor", "word", None, False, None, False, "auto,cpu_predictor,gpu_predictor"),
    ("monotone_constraints", "tuple", -1, False, 1, False, None),
    ("interaction_constraints", "nested", 1, False, None, False, None),
    ("sample_type", "word", None, False, None, False, "uniform,weighted"),
    ("normalize_type", "word", None, False, None, False, "tree,forest"),
    ("rate_drop", "float", 0, False, 1, False, None),
    ("one_drop", "int", 0, False, 1, False, None),
    ("skip_drop", "float", 0, False, 1, False, None),
    ("lambda_bias", "float", 0, False, 1, False, None),
    ("tweedie_variance_power", "float", 1, True, 2, True, None),
    ("objective", "word", None, False, None, False,
     "binary:logistic,binary:logitraw,binary:hinge,count:poisson,multi:softmax,multi:softprob,rank:pairwise,rank:ndcg,"
     "rank:map,reg:linear,reg:squarederror,reg:logistic,reg:gamma,reg:pseudohubererror,reg:squaredlogerror,"
     "reg:absoluteerror,reg:tweedie,survival:aft,survival:cox"),
    ("num_class", "int", 2, False, None, False, None),
    ("base_score", "float", 0, False, None, False, None),
    ("_kfold", "int", 2, False, None, False, None),
    ("_num_cv_round", "int", 1, False, None, False, None),
    ("_tuning_objective_metric", "word", None, False, None, False, ",".join(f"validation:{m}" for m in MAXIMIZE + MINIMIZE)),
    ("eval_metric", "words", None, False, None, False, ",".join(MAXIMIZE + MINIMIZE)),
    ("seed", "int", -(2**31), True, 2**31 - 1, True, None),
    ("num_parallel_tree", "int", 1, False, None, False, None),
    ("save_model_on_termination", "word", None, False, None, False, "true,false"),
    ("aft_loss_distribution", "word", None, False, None, False, "normal,logistic,extreme"),
    ("aft_loss_distribution_scale", "float", 0, False, None, False, None),
    ("deterministic_histogram", "word", None, False, None, False, "true,false"),
    ("sampling_method", "word", None, False, None, False, "uniform,gradient_based"),
    ("prob_buffer_row", "int", 1, True, None, False, None),
    ("use_dask_gpu_training", "word", None, False, None, False, "true,false"),
]
REQUIRED = ("num_round",)
ALIASES = {"learning_rate": "eta", "min_split_loss": "gamma", "reg_lambda": "lambda", "reg_alpha": "alpha"}
THRESHOLD_METRICS = ("error", "ndcg", "map")

# Defaults of the published algorithm, used when a parameter is not given.
DEFAULTS = {
    "booster": "gbtree", "eta": 0.3, "gamma": 0.0, "max_depth": 6, "min_child_weight": 1.0, "max_delta_step": 0.0,
    "subsample": 1.0, "colsample_bytree": 1.0, "colsample_bylevel": 1.0, "colsample_bynode": 1.0, "lambda": 1.0,
    "alpha": 0.0, "scale_pos_weight": 1.0, "grow_policy": "depthwise", "max_leaves": 0, "max_bin": 256,
    "sample_type": "uniform", "normalize_type": "tree", "rate_drop": 0.0, "one_drop": 0, "skip_drop": 0.0,
    "tweedie_variance_power": 1.5, "objective": "reg:squarederror", "seed": 0, "num_parallel_tree": 1,
    "aft_loss_distribution": "normal", "aft_loss_distribution_scale": 1.0, "deterministic_histogram": "true",
    "sampling_method": "uniform", "refresh_leaf": 1, "process_type": "default",
}


def _parse(kind: str, value):
    if kind == "int":
        return int(value)
    if kind == "float":
        return float(value)
    if kind == "words":
        return [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value)
    if kind in ("tuple", "nested"):
        return ast.literal_eval(value) if isinstance(value, str) else value
    return str(value)


def _in_bounds(value, low, low_open, high, high_open) -> bool:
    if low is not None and (value <= low if low_open else value < low):
        return False
    return not (high is not None and (value >= high if high_open else value > high))


def _metric_allowed(metric: str) -> bool:
    name, at, threshold = metric.partition("@")
    if not at:
        return name in MAXIMIZE + MINIMIZE
    try:
        float(threshold)
    except ValueError:
        return False
    return name.strip() in THRESHOLD_METRICS


def _check_range(name: str, rule: tuple, value) -> None:
    _, kind, low, low_open, high, high_open, words = rule
    if name == "eval_metric":
        ok = all(_metric_allowed(v) for v in value)
    elif kind == "words":
        ok = set(value) <= set(words.split(","))
    elif kind == "word":
        ok = value in words.split(",")
    elif kind == "tuple":
        ok = all(_in_bounds(v, low, low_open, high, high_open) for v in value)
    elif kind == "nested":
        ok = all(_in_bounds(v, low, low_open, high, high_open) for group in value for v in group)
    else:
        ok = _in_bounds(value, low, low_open, high, high_open)
    if not ok:
        raise ValueError(f"parameter {name}: value {value} not in range")


def _check_together(p: Mapping) -> None:
    objective = p.get("objective")
    if objective in ("multi:softmax", "multi:softprob") and p.get("num_class") is None:
        raise ValueError("num_class is required for multi-class objectives")
    metrics = p.get("eval_metric") or []
    if "auc" in metrics and not str(objective or "").startswith(("binary:", "rank:")):
        raise ValueError("metric auc needs a binary or ranking objective")
    if "aft-nloglik" in metrics and objective != "survival:aft":
        raise ValueError("metric aft-nloglik needs objective survival:aft")
    if p.get("monotone_constraints") is not None and p.get("tree_method") not in ("exact", "hist"):
        raise ValueError("monotone_constraints need tree_method exact or hist")
    if p.get("interaction_constraints") is not None and p.get("tree_method") not in ("exact", "hist", "approx"):
        raise ValueError("interaction_constraints need tree_method exact, hist or approx")
    updater = p.get("updater")
    if updater is not None:
        builders = {"grow_colmaker", "distcol", "grow_histmaker", "grow_quantile_histmaker"}
        if p.get("booster") == "gblinear":
            if not (len(updater) == 1 and updater[0] in ("shotgun", "coord_descent")):
                raise ValueError("a linear booster takes exactly one of shotgun, coord_descent")
        elif p.get("process_type") == "update":
            if not set(updater) <= {"refresh", "prune"}:
                raise ValueError("process_type update takes refresh and prune only")
        elif set(updater) & {"shotgun", "coord_descent"} or sum(u in builders for u in updater) > 1:
            raise ValueError("at most one tree-building updater, and no linear ones")
    base = p.get("base_score")
    if base is not None and objective in ("binary:logistic", "reg:logistic") and not 0 < base < 1:
        raise ValueError("base_score must be in (0,1) for logistic loss")


def resolve_parameters(given: Mapping, with_defaults: bool = True) -> dict:
    """Aliases replaced, text parsed, ranges and dependencies checked; defaults filled in."""
    rules = {r[0]: r for r in RULES}
    named = {ALIASES.get(k, k): v for k, v in given.items()}
    for name in REQUIRED:
        if name not in named:
            raise ValueError(f"missing required parameter: {name}")
    parsed = {}
    for name, value in named.items():
        if name not in rules:
            raise ValueError(f"extraneous parameter: {name}")
        try:
            parsed[name] = _parse(rules[name][1], value)
        except (ValueError, SyntaxError) as e:
            raise ValueError(f"parameter {name}: could not parse value") from e
        _check_range(name, rules[name], parsed[name])
    _check_together(parsed)
    if not with_defaults:
        return parsed
    out = {**DEFAULTS, **parsed}
    if parsed.get("sketch_eps") and "max_bin" not in parsed:
        out["max_bin"] = max(2, int(1 / parsed["sketch_eps"]))
    if out["objective"] == "count:poisson" and "max_delta_step" not in parsed:
        out["max_delta_step"] = 0.7
    return out
