"""Every registered query of the engine."""

from . import label_queries, number_queries, rule_queries, source_queries, stream_queries, text_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
