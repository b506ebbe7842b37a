"""Registered queries of the engine and the SQL that states the same result."""

from __future__ import annotations

from eddyline.plans import queries_more, queries_scalar, queries_stream, queries_windows
from eddyline.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_more", "queries_scalar", "queries_stream", "queries_windows"]
