"""Web-Mercator quadtree arithmetic as columns: all stays in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latitude at which the square world ends.
MAX_LAT = 85.05112878


def world_x(lon: Column) -> Column:
    """0 at 180 W to 1 at 180 E."""
    return (lon + 180.0) / 360.0


def world_y(lat: Column) -> Column:
    """0 in the north to 1 in the south; latitudes beyond the square are clamped."""
    clamped = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))
    return (1.0 - F.asinh(F.tan(F.radians(clamped))) / F.pi()) / 2.0


def inverse_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y))))


def inverse_lon(x: Column) -> Column:
    return x * 360.0 - 180.0


def tile_index(world: Column, z: int | Column) -> Column:
    """Number of the tile along one axis, kept inside the world."""
    side = F.expr("1L") * F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))
    return F.greatest(F.lit(0), F.least(F.floor(world * side), side - 1)).cast("bigint")


def tile_x(lon: Column, z: int | Column) -> Column:
    return tile_index(world_x(lon), z)


def tile_y(lat: Column, z: int | Column) -> Column:
    return tile_index(world_y(lat), z)


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Z-order code: bits of x and y in turn, x in the lower place."""
    code = F.lit(0).cast("bigint")
    for b in range(bits):
        for at, v in ((2 * b, x), (2 * b + 1, y)):
            code = code + F.shiftleft(F.shiftright(v.cast("bigint"), b).bitwiseAND(F.lit(1).cast("bigint")), at)
    return code


def parent(v: Column, levels: int) -> Column:
    """An index some zooms farther out."""
    return F.shiftright(v, levels)
