"""Registry of queries: a name, a function (spark, sf_dir) -> DataFrame, and the same result as SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with SQL that gives the same rows where SQL can."""

    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add
