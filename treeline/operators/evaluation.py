"""Weighted evaluation metrics that are a sum of per-row terms: ``sum(w*term) / sum(w)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from treeline.functions.scores import argmax_label, lgamma, survival_pdf_cdf

# Metrics accepted by name and the direction in which each improves.
MAXIMIZE = (
    "accuracy", "auc", "aucpr", "balanced_accuracy", "f1", "f1_binary", "f1_macro", "map", "ndcg", "precision",
    "r2", "recall", "precision_macro", "precision_micro", "recall_macro", "recall_micro",
)
MINIMIZE = (
    "aft-nloglik", "cox-nloglik", "error", "gamma-deviance", "gamma-nloglik", "interval-regression-accuracy",
    "logloss", "mae", "mape", "merror", "mlogloss", "mphe", "mse", "poisson-nloglik", "rmse", "rmsle",
    "tweedie-nloglik",
)
PROBABILITY_FLOOR = 1e-16
LIKELIHOOD_FLOOR = 1e-12


def is_maximize(metric: str) -> bool:
    return metric.split("@")[0].strip() in MAXIMIZE


def _clip(p: Column, floor: float = PROBABILITY_FLOOR) -> Column:
    return F.greatest(F.least(p, F.lit(1.0 - floor)), F.lit(floor))


def aft_term(lower: Column, upper: Column, p: Column, distribution: str, sigma: float) -> Column:
    """Negative log likelihood of one interval ``[lower, upper]``; NULL or infinite upper = right censored."""
    open_end = upper.isNull() | (upper == F.lit(float("inf")))
    z_low = (F.log(lower) - F.log(p)) / sigma
    z_up = (F.log(upper) - F.log(p)) / sigma
    pdf, cdf_low = survival_pdf_cdf(z_low, distribution)
    _, cdf_up = survival_pdf_cdf(z_up, distribution)
    at_or_below = F.when(lower <= 0, F.lit(0.0)).otherwise(cdf_low)
    exact = pdf / (sigma * lower)
    interval = F.when(open_end, F.lit(1.0)).otherwise(cdf_up) - at_or_below
    likelihood = F.when(~open_end & (lower == upper), exact).otherwise(interval)
    return -F.log(F.greatest(likelihood, F.lit(LIKELIHOOD_FLOOR)))


def row_term(metric: str, y: Column, p: Column, options: dict) -> tuple[Column, bool]:
    """Per-row term and whether the mean is followed by a square root."""
    name, _, at = metric.partition("@")
    name = name.strip()
    if name == "logloss":
        q = _clip(p)
        return -(y * F.log(q) + (1.0 - y) * F.log(1.0 - q)), False
    if name == "error":
        cut = float(at) if at else 0.5
        return ((p > cut).cast("int") != y.cast("int")).cast("double"), False
    if name == "merror":
        return (argmax_label(p) != y.cast("int")).cast("double"), False
    if name == "mlogloss":
        return -F.log(F.greatest(F.get(p, y.cast("int")), F.lit(PROBABILITY_FLOOR))), False
    if name == "rmse":
        return (y - p) * (y - p), True
    if name == "mse":
        return (y - p) * (y - p), False
    if name == "mae":
        return F.abs(y - p), False
    if name == "mape":
        undefined = F.when(p == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
        return F.when(y == 0, undefined).otherwise(F.abs(F.try_divide(y - p, y))), False
    if name == "mphe":
        z = (y - p) / float(options.get("huber_slope", 1.0))
        return (F.sqrt(1.0 + z * z) - 1.0) * float(options.get("huber_slope", 1.0)) ** 2, False
    if name == "rmsle":
        d = F.log1p(p) - F.log1p(y)
        return d * d, True
    if name == "poisson-nloglik":
        q = F.greatest(p, F.lit(PROBABILITY_FLOOR))
        return q - y * F.log(q) + lgamma(y + 1.0), False
    if name == "gamma-nloglik":
        return F.try_divide(y, p) + F.log(p), False
    if name == "gamma-deviance":
        ratio = F.try_divide(y, p)
        return 2.0 * (ratio - F.log(ratio) - 1.0), False
    if name == "tweedie-nloglik":
        rho = float(at) if at else float(options.get("tweedie_variance_power", 1.5))
        return -y * F.pow(p, F.lit(1 - rho)) / (1 - rho) + F.pow(p, F.lit(2 - rho)) / (2 - rho), False
    if name == "aft-nloglik":
        term = aft_term(
            F.col(options.get("lower", "label_lower")), F.col(options.get("upper", "label_upper")), p,
            options.get("aft_loss_distribution", "normal"), float(options.get("aft_loss_distribution_scale", 1.0)),
        )
        return term, False
    if name == "interval-regression-accuracy":
        low, up = F.col(options.get("lower", "label_lower")), F.col(options.get("upper", "label_upper"))
        # an open limit is NULL
        return (F.coalesce(p >= low, F.lit(True)) & F.coalesce(p <= up, F.lit(True))).cast("double"), False
    raise ValueError(f"not a per-row metric: {metric}")


POINTWISE = (
    "logloss", "error", "merror", "mlogloss", "rmse", "mse", "mae", "mape", "mphe", "rmsle", "poisson-nloglik",
    "gamma-nloglik", "gamma-deviance", "tweedie-nloglik", "aft-nloglik", "interval-regression-accuracy",
)


def is_pointwise(metric: str) -> bool:
    return metric.split("@")[0].strip() in POINTWISE


def mean_aggregate(metric: str, y: Column, p: Column, w: Column, options: dict | None = None) -> Column:
    """Aggregate Column of a per-row metric, for use next to others in one ``agg``.

    A row whose term is undefined (a logarithm of a negative value, a missing label) makes the metric NaN.
    """
    term, root = row_term(metric, y, p, options or {})
    mean = F.sum(w * term) / F.sum(w)
    mean = F.when(F.count_if(term.isNull() & w.isNotNull()) > 0, F.lit(float("nan"))).otherwise(mean)
    return F.sqrt(mean) if root else mean


def evaluate_rows(
    df: DataFrame,
    metrics: Sequence[str],
    label: str = "label",
    pred: str = "pred",
    weight: str | None = None,
    keys: Sequence[str] = (),
    **options,
) -> DataFrame:
    """``keys, metric, value`` for any number of per-row metrics in one pass over the rows."""
    y, p = F.col(label).cast("double"), F.col(pred)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    aggregates = [mean_aggregate(m, y, p, w, options).alias(f"v{i}") for i, m in enumerate(metrics)]
    wide = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"v{i}").alias("value")) for i, m in enumerate(metrics)])
    ).alias("m")
    return wide.select(*keys, pairs).select(*keys, "m.metric", "m.value")
