"""Queries over the shared tables and the SQL each must agree with."""

from __future__ import annotations

from catalog import cross_validation, data_checks, evaluation, experiments, metrics, scoring, sources, training
from catalog.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
_ = (cross_validation, data_checks, evaluation, experiments, metrics, scoring, sources, training)
