"""First and second derivatives of each objective, and the link from margin to prediction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from treeline.functions.scores import sigmoid_probability, softmax, survival_pdf_cdf

SMALL_HESSIAN = 1e-6
TINY_HESSIAN = 1.1754943508222875e-38
ROW_OBJECTIVES = (
    "reg:squarederror", "reg:linear", "reg:logistic", "binary:logistic", "binary:logitraw", "binary:hinge",
    "count:poisson", "reg:gamma", "reg:tweedie", "reg:squaredlogerror", "reg:pseudohubererror", "reg:absoluteerror",
    "multi:softmax", "multi:softprob", "survival:aft",
)
GROUP_OBJECTIVES = ("rank:pairwise", "rank:ndcg", "rank:map", "survival:cox")


def is_multiclass(objective: str) -> bool:
    return objective.startswith("multi:")


def default_base(objective: str) -> float:
    """Starting prediction on the output scale when ``base_score`` is not given."""
    if objective in GROUP_OBJECTIVES and objective.startswith("rank:"):
        return 0.0
    return 1.0 if objective in ("survival:cox", "survival:aft") else 0.5


def base_margin(objective: str, base_score: float) -> float:
    if objective in ("reg:logistic", "binary:logistic", "binary:logitraw"):
        return math.log(base_score / (1.0 - base_score)) if 0 < base_score < 1 else base_score
    if objective in ("count:poisson", "reg:gamma", "reg:tweedie", "survival:cox", "survival:aft"):
        return math.log(base_score)
    return base_score


def link(objective: str, margins: list[Column]) -> Column:
    """Prediction as returned to the user."""
    m = margins[0]
    if objective in ("reg:logistic", "binary:logistic"):
        return sigmoid_probability(m)
    if objective == "binary:hinge":
        return (m > 0).cast("double")
    if objective in ("count:poisson", "reg:gamma", "reg:tweedie", "survival:cox", "survival:aft"):
        return F.exp(m)
    if objective == "multi:softprob":
        return F.array(*softmax(margins))
    if objective == "multi:softmax":
        scores = F.array(*margins)
        return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")
    return m


def _aft_pairs(lower: Column, upper: Column, m: Column, dist: str, sigma: float) -> tuple[Column, Column]:
    """Derivatives of the interval likelihood by the margin (log time)."""
    open_end = upper.isNull() | (upper == F.lit(float("inf")))
    zl, zu = (F.log(lower) - m) / sigma, (F.log(upper) - m) / sigma

    def slopes(z: Column) -> tuple[Column, Column]:
        """d ln f/dz and d2 ln f/dz2."""
        if dist == "normal":
            return -z, F.lit(-1.0)
        if dist == "logistic":
            p = sigmoid_probability(z)
            return 1.0 - 2.0 * p, -2.0 * p * (1.0 - p)
        return 1.0 - F.exp(z), -F.exp(z)

    first, second = slopes(zl)
    exact_g, exact_h = first / sigma, -second / (sigma * sigma)
    fl, cl = survival_pdf_cdf(zl, dist)
    fu_in, cu_in = survival_pdf_cdf(zu, dist)
    low_open = lower <= 0
    fu = F.when(open_end, F.lit(0.0)).otherwise(fu_in)
    cu = F.when(open_end, F.lit(1.0)).otherwise(cu_in)
    fl, cl = F.when(low_open, F.lit(0.0)).otherwise(fl), F.when(low_open, F.lit(0.0)).otherwise(cl)
    dfu = F.when(open_end, F.lit(0.0)).otherwise(fu_in * slopes(zu)[0])
    dfl = F.when(low_open, F.lit(0.0)).otherwise(survival_pdf_cdf(zl, dist)[0] * slopes(zl)[0])
    mass = F.greatest(cu - cl, F.lit(1e-12))
    g = (fu - fl) / (sigma * mass)
    h = -((dfu - dfl) * mass - (fu - fl) * (fu - fl)) / (sigma * sigma * mass * mass)
    exact = ~open_end & (lower == upper)
    g, h = F.when(exact, exact_g).otherwise(g), F.when(exact, exact_h).otherwise(h)
    return F.greatest(F.least(g, F.lit(15.0)), F.lit(-15.0)), F.greatest(F.least(h, F.lit(15.0)), F.lit(1e-16))


def row_gradients(objective: str, y: Column, margins: list[Column], params: dict) -> list[tuple[Column, Column]]:
    """One (g, h) pair per class for objectives that only need the row itself."""
    m = margins[0]
    one = F.lit(1.0)
    if objective in ("reg:squarederror", "reg:linear"):
        return [(m - y, one)]
    if objective in ("reg:logistic", "binary:logistic", "binary:logitraw"):
        p = sigmoid_probability(m)
        return [(p - y, F.greatest(p * (1.0 - p), F.lit(1e-16)))]
    if objective == "binary:hinge":
        side = 2.0 * y - 1.0
        inside = m * side < 1.0
        return [(F.when(inside, -side).otherwise(0.0), F.when(inside, one).otherwise(F.lit(TINY_HESSIAN)))]
    if objective == "count:poisson":
        return [(F.exp(m) - y, F.exp(m + float(params["max_delta_step"])))]
    if objective == "reg:gamma":
        r = y * F.exp(-m)
        return [(1.0 - r, r)]
    if objective == "reg:tweedie":
        rho = float(params["tweedie_variance_power"])
        a, b = F.exp((1 - rho) * m), F.exp((2 - rho) * m)
        return [(-y * a + b, -y * (1 - rho) * a + (2 - rho) * b)]
    if objective == "reg:squaredlogerror":
        p = F.greatest(m, F.lit(-1 + 1e-6))
        d = F.log1p(p) - F.log1p(y)
        return [(d / (p + 1.0), F.greatest((1.0 - d) / F.pow(p + 1.0, F.lit(2.0)), F.lit(SMALL_HESSIAN)))]
    if objective == "reg:pseudohubererror":
        z = m - y
        s = 1.0 + z * z
        return [(z / F.sqrt(s), 1.0 / (s * F.sqrt(s)))]
    if objective == "reg:absoluteerror":
        return [(F.signum(m - y), one)]
    if is_multiclass(objective):
        out = []
        for k, p in enumerate(softmax(margins)):
            out.append((p - (y == k).cast("double"), F.greatest(2.0 * p * (1.0 - p), F.lit(1e-16))))
        return out
    if objective == "survival:aft":
        return [_aft_pairs(
            F.col("label_lower"), F.col("label_upper"), m,
            params["aft_loss_distribution"], float(params["aft_loss_distribution_scale"]),
        )]
    raise ValueError(f"objective {objective} needs its group: use group_gradients")


def gradient_pairs(
    df: DataFrame, objective: str, params: dict, label: str = "label", weight: str | None = "weight", margins: tuple[str, ...] = ("m_0",)
) -> DataFrame:
    """Adds ``g_k, h_k`` per class, multiplied by the row weight."""
    y = F.col(label).cast("double")
    w = F.col(weight) if weight else F.lit(1.0)
    spw = float(params.get("scale_pos_weight", 1.0))
    if spw != 1.0:
        w = scale_positive_weight(y, w, spw)
    columns = []
    for k, (g, h) in enumerate(row_gradients(objective, y, [F.col(c) for c in margins], params)):
        columns += [(g * w).alias(f"g_{k}"), (h * w).alias(f"h_{k}")]
    return df.select("*", *columns)


def scale_positive_weight(label: Column, weight: Column, factor: float) -> Column:
    """Weight multiplied by ``factor`` on rows of class 1."""
    return F.when(label == 1, weight * float(factor)).otherwise(weight)
