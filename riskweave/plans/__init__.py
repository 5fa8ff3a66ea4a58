"""Registered queries with their SQL equivalents."""

from . import evaluation, labelling, leads, matching, matrix, models, robustness, scores, serving  # noqa: F401  each registers its queries
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
