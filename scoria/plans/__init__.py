"""Registered queries and their SQL."""

from __future__ import annotations

from . import classify, delivery, grid, ledger, match, more, problems, shapes, tracks  # noqa: I001
from . import files  # reads the SQL of tracks
from .registry import ORACLE as _ORACLE
from .registry import QUERIES as _QUERIES

__all__ = ["ORACLE", "QUERIES", "classify", "delivery", "grid", "ledger", "match", "more", "problems", "shapes", "tracks"]

QUERIES = {**problems.QUERIES, **_QUERIES}
ORACLE = {**problems.ORACLE, **_ORACLE}
