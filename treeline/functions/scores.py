"""Links, labels and special functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def sigmoid_probability(x: Column) -> Column:
    """Logistic link written with tanh, which does not overflow for large negative margins."""
    return 0.5 * (1.0 + F.tanh(0.5 * x))


def argmax_label(scores: Column) -> Column:
    """Position of the first maximum of an array of class scores."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def threshold_label(score: Column, threshold: float = 0.0) -> Column:
    return F.when(score.isNotNull(), (score > F.lit(float(threshold))).cast("int"))


def margin_to_label(score: Column, is_array: bool = False, threshold: float = 0.0) -> Column:
    """Class from a raw prediction: argmax for class scores, threshold for a single score."""
    return argmax_label(score) if is_array else threshold_label(score, threshold)


def softmax(margins: list[Column]) -> list[Column]:
    """Class probabilities, shifted by the largest margin before exponentiation."""
    top = F.greatest(*margins) if len(margins) > 1 else margins[0]
    powers = [F.exp(m - top) for m in margins]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return [p / total for p in powers]


# Stirling series coefficients of ln(gamma), powers z^-1, z^-3, z^-5, z^-7.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def lgamma(x: Column) -> Column:
    """ln(gamma(x)) for x > 0: shift by ten, then the Stirling series (error below 1e-12)."""
    rising = x
    for step in range(1, 10):
        rising = rising * (x + float(step))
    z = x + 10.0
    series = sum((c * F.pow(z, F.lit(-float(2 * i + 1))) for i, c in enumerate(STIRLING)), F.lit(0.0))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(rising)


# Chebyshev fit of ln(erfc), relative error below 1.2e-7 everywhere.
ERFC_FIT = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function through the complementary error function."""
    u = x / math.sqrt(2.0)
    size = F.abs(u)
    t = 1.0 / (1.0 + 0.5 * size)
    poly = F.lit(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = poly * t + c
    tail = t * F.exp(poly - size * size)
    return F.when(u >= 0, 1.0 - 0.5 * tail).otherwise(0.5 * tail)


def normal_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def survival_pdf_cdf(z: Column, distribution: str) -> tuple[Column, Column]:
    """Density and distribution function of the standardised log time."""
    if distribution == "normal":
        return normal_pdf(z), normal_cdf(z)
    if distribution == "logistic":
        p = sigmoid_probability(z)
        return p * (1.0 - p), p
    if distribution == "extreme":
        w = F.exp(z)
        return w * F.exp(-w), 1.0 - F.exp(-w)
    raise ValueError(f"unknown aft_loss_distribution: {distribution}")
