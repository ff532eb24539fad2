"""Boosted-tree training, evaluation and scoring expressed as Spark DataFrame plans."""

from treeline.session import build_session

__all__ = ["build_session"]
