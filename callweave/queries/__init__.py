"""Queries over the given tables, one for each operator, and their SQL."""

from . import batch_labels, batch_models, batch_reports, batch_texts, files  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
