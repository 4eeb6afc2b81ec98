"""Regions of equal values in small rasters: each block is one group, bounded by its width and height."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, g, register


def label(grid: np.ndarray) -> np.ndarray:
    """Number of each cell's region of equal values, 4-connected; the least cell number names it."""
    h, w = grid.shape
    out = np.arange(h * w).reshape(h, w)
    while True:
        new = out.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            low = np.where(grid[a] == grid[b], np.minimum(new[a], new[b]), h * w)
            new[a] = np.minimum(new[a], low)  # never upwards, or the rounds need not end
            new[b] = np.minimum(new[b], low)
        new = np.minimum(new, new.ravel()[new])  # jump to the label's label
        if (new == out).all():
            return out
        out = new


def sieve_grid(grid: np.ndarray, least: int) -> np.ndarray:
    """Regions of fewer than `least` cells take the value of their largest neighbour, smallest regions first."""
    grid = grid.copy()
    while True:
        regions = label(grid)
        ids, counts = np.unique(regions, return_counts=True)
        size = dict(zip(ids.tolist(), counts.tolist()))
        for region in sorted((i for i in size if size[i] < least), key=lambda i: (size[i], i)):
            mask = regions == region
            edge = np.zeros_like(mask)
            edge[1:] |= mask[:-1]
            edge[:-1] |= mask[1:]
            edge[:, 1:] |= mask[:, :-1]
            edge[:, :-1] |= mask[:, 1:]
            around = {int(i) for i in regions[edge & ~mask]}
            if around:
                best = max(around, key=lambda i: (size[i], -i))
                grid[mask] = grid.ravel()[best]
                break
        else:
            return grid


def _grid(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros((pdf["r"].max() + 1, pdf["c"].max() + 1), int)
    out[pdf["r"], pdf["c"]] = pdf["v"]
    return out


def sieved(cells: DataFrame, least: int) -> DataFrame:
    """Cells (id, r, c, v) of whole blocks after the sieve."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = sieve_grid(_grid(pdf), least)
        return pdf.assign(v=grid[pdf["r"], pdf["c"]])[["id", "r", "c", "v"]]

    return cells.groupBy("id").applyInPandas(one, "id bigint, r int, c int, v int")


def regions(cells: DataFrame) -> DataFrame:
    """(id, region, v, pixels, outline length in cell sides) of each region of equal values."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = _grid(pdf)
        lab = label(grid)
        padded = np.pad(lab, 1, constant_values=-1)
        sides = sum((padded[1:-1, 1:-1] != padded[a, b]).astype(int) for a, b in ((slice(0, -2), slice(1, -1)), (slice(2, None), slice(1, -1)), (slice(1, -1), slice(0, -2)), (slice(1, -1), slice(2, None))))
        flat = pd.DataFrame({"region": lab.ravel(), "v": grid.ravel(), "sides": sides.ravel()})
        out = flat.groupby("region").agg(v=("v", "first"), pixels=("v", "size"), sides=("sides", "sum")).reset_index()
        return out.assign(id=pdf["id"].iloc[0])[["id", "region", "v", "pixels", "sides"]]

    return cells.groupBy("id").applyInPandas(one, "id bigint, region bigint, v int, pixels bigint, sides bigint")


def polygons(cells: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(id, region, v, shape) of regions of equal values as areas in cell sides, simplified by a part of one.

    Cells of a row that touch are one rectangle before they are joined, so that a region is few shapes.
    """
    register(cells.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = _grid(pdf)
        lab = label(grid)
        start = np.ones_like(lab, bool)
        start[:, 1:] = lab[:, 1:] != lab[:, :-1]
        r, c = np.nonzero(start)
        end = np.append(c[1:], 0)
        end = np.where(np.append(r[1:] == r[:-1], False), end, lab.shape[1])
        return pd.DataFrame({"id": pdf["id"].iloc[0], "region": lab[r, c], "v": grid[r, c], "r": r, "c0": c, "c1": end})

    runs = cells.groupBy("id").applyInPandas(one, "id bigint, region bigint, v int, r int, c0 int, c1 int")
    shapes = runs.groupBy("id", "region", "v").agg(g("Union", F.collect_list(box(F.col("c0"), F.col("r"), F.col("c1"), F.col("r") + 1))).alias("shape"))
    return shapes.withColumn("shape", g("Rounded", F.col("shape"), tolerance, 6))
