"""Positions on the sphere, as columns and as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8


def usable(lon: Column, lat: Column) -> Column:
    """A known position: both present and in range, and not 0, 0. NaN is out of range."""
    return F.coalesce(
        lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0) & ~((lon == 0) & (lat == 0)), F.lit(False)
    )


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle metres between two positions."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def unit_xyz(lon, lat) -> np.ndarray:
    """Unit vectors, one row for each position in degrees."""
    lon, lat = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    c = np.cos(lat)
    return np.stack([c * np.cos(lon), c * np.sin(lon), np.sin(lat)], axis=1)


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle angle in radians; exact for near points, since it goes by the chord."""
    d = a - b
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(np.einsum("...i,...i->...", d, d)) / 2))
