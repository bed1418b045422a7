"""All registered queries, by the names of the operator inventory."""

from __future__ import annotations

from . import q_bars, q_jobs, q_results, q_sources, q_summary  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
