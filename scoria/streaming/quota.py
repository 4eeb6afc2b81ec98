"""Quotas with check-then-add: a denied request uses nothing, so later smaller ones may pass."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def take(amounts, used: int, limit: int) -> tuple[list[bool], int]:
    """Which amounts fit, in order, and what is used after."""
    out = []
    for a in amounts:
        ok = used + a <= limit
        used += a if ok else 0
        out.append(ok)
    return out, used


def charge(requests: DataFrame, key: list[str], limit: int, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Requests with `allowed`, in order within a key (a role's month).

    The fold is sequential within a key, which holds one period of one role.
    """
    cols = requests.columns

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        return pdf[cols].assign(allowed=take(pdf["amount"].tolist(), 0, limit)[0])

    schema = ", ".join(f"`{n}` {t.dataType.simpleString()}" for n, t in zip(cols, requests.schema)) + ", allowed boolean"
    return requests.groupBy(*key).applyInPandas(fold, schema)
