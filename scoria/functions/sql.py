"""The engine's functions for SQL text: inlined by Catalyst where they are arithmetic, tables where they make rows."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import geometry

#: name and parameters, type, body.
SCALARS = (
    ("world_x(lon DOUBLE)", "DOUBLE", "(lon + 180) / 360"),
    ("world_y(lat DOUBLE)", "DOUBLE", "(1 - asinh(tan(radians(greatest(-85.05112878D, least(85.05112878D, lat))))) / pi()) / 2"),
    ("inverse_lat(y DOUBLE)", "DOUBLE", "degrees(atan(sinh(pi() * (1 - 2 * y))))"),
    ("tile_of(world DOUBLE, z INT)", "BIGINT", "greatest(0L, least(cast(floor(world * shiftleft(1L, z)) as bigint), shiftleft(1L, z) - 1))"),
    ("haversine_m(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE)", "DOUBLE",
     "2 * 6371008.8D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    ("flat_m(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE)", "DOUBLE",
     "sqrt(pow((pmod(lon1 - lon2 + 180, 360D) - 180) * 111320 * cos(radians((lat1 + lat2) / 2)), 2) + pow((lat1 - lat2) * 111320, 2))"),
    ("retry_after(attempts INT)", "DOUBLE", "least(3600D, 30 * pow(2D, least(attempts, 7)))"),
    ("from_terrarium(r INT, g INT, b INT)", "DOUBLE", "r * 256 + g + b / 256D - 32768"),
)


@udtf(returnType="z int, x bigint, y bigint")
class TileCover:
    """The tiles of a zoom that bounds touch."""

    def eval(self, z: int, west: float, south: float, east: float, north: float):
        n = 1 << z
        at = lambda lon, lat: (
            (lon + 180) / 360, (1 - math.asinh(math.tan(math.radians(max(-85.05112878, min(85.05112878, lat))))) / math.pi) / 2,
        )
        if None in (z, west, south, east, north):
            return
        (x0, y0), (x1, y1) = at(west, north), at(east, south)
        cut = lambda v: max(0, min(n - 1, math.floor(v * n)))
        for x in range(cut(x0), cut(x1) + 1):
            for y in range(cut(y0), cut(y1) + 1):
                yield z, x, y


def register(spark: SparkSession) -> None:
    """Make the functions known to a session under their names, beside the geometry functions (g_...)."""
    for head, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("tile_cover", TileCover)
    geometry.register(spark)
