"""Training-data operators on records and texts: queries and SQL."""

from __future__ import annotations

from . import queries

QUERIES = queries.QUERIES
ORACLE = queries.ORACLE
