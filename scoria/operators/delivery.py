"""Tiles as they are handed out: their validity, the keys around a place, grids of downloads and how they are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mercator as m
from . import grid


def contour_bounds(z: Column, x: Column, y: Column) -> Column:
    """struct(west, north, east, south) of a contour tile as fractions of the world; null outside zooms 11 to 14 and the world."""
    n = F.pow(F.lit(2.0), z)
    ok = z.between(11, 14) & (x >= 0) & (y >= 0) & (x < n) & (y < n)
    return F.when(ok, F.struct((x / n).alias("west"), (y / n).alias("north"), ((x + 1) / n).alias("east"), ((y + 1) / n).alias("south")))


def cell_keys(places: DataFrame, cell: int = 12, lowest: int = 6, deepest: int = 14) -> DataFrame:
    """Distinct (z, x, y) of the cells of some places, of the tiles above them and of those below."""
    at = grid.assign(places, cell).select("z", "x", "y").distinct()
    out = at.unionByName(grid.ancestors(at, lowest).select("z", "x", "y"))
    for levels in range(1, deepest - cell + 1):
        out = out.unionByName(grid.descendants(at, levels).select("z", "x", "y"))
    return out.distinct()


def download_grid(west: Column, south: Column, east: Column, north: Column, zoom: Column, cells: int = 12, most: int = 600) -> Column:
    """struct(columns, rows, zoom): a view's cells, and the zoom to go to where they are more than can be shown."""
    columns = F.greatest(F.lit(1), m.tile_x(east, cells) - m.tile_x(west, cells) + 1)
    rows = F.greatest(F.lit(1), m.tile_y(south, cells) - m.tile_y(north, cells) + 1)
    closer = F.least(F.lit(18.0), zoom + F.log2(F.greatest(columns, rows) / 20.0))
    return F.struct(columns.alias("columns"), rows.alias("rows"), F.when((columns * rows > most) & (closer > zoom), closer).otherwise(zoom).alias("zoom"))


def bytes_text(size: Column) -> Column:
    """A size in MB, or GB from a billion bytes on, with two places."""
    return F.when(size >= 1e9, F.format_string("%.2f GB", size / 1e9)).otherwise(F.format_string("%.2f MB", size / 1e6))


def percent(done: Column, total: Column) -> Column:
    """Whole hundredths done, at most 100; 0 of nothing."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(done / total * 100 + 0.5).cast("int"))).otherwise(0)


def area_text(x: Column, y: Column, z: int = 12) -> Column:
    """What a download's cell is called: the place of its middle."""
    n = 2.0**z
    lat, lon = m.inverse_lat((y + 0.5) / n), m.inverse_lon((x + 0.5) / n)
    side = lambda v, minus, plus: F.when(v < 0, minus).otherwise(plus)
    return F.format_string("Area near %.2f°%s, %.2f°%s", F.abs(lat), side(lat, "S", "N"), F.abs(lon), side(lon, "W", "E"))


def waterways(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """Line features (id, packed) with their way's tags (way, intermittent, seasonal) and how long the stream runs; others stay without."""
    from ..functions.hashing import packed_way_id
    from .classify import flow

    at = lines.withColumn("way", packed_way_id(F.col("packed")))
    j = at.join(tags, "way", "left")
    return j.select("id", "way", flow(F.col("intermittent"), F.col("seasonal")).alias("flow"))


def meets(west: Column, south: Column, east: Column, north: Column, extent: tuple[float, float, float, float]) -> Column:
    """Whether bounds meet an extent (west, south, east, north), edges with it."""
    w, s, e, n = extent
    return (east >= w) & (west <= e) & (north >= s) & (south <= n)


def world_wrapped(lon: Column) -> Column:
    """A longitude as a fraction of the world, whatever turns it has made."""
    return F.pmod(m.world_x(lon), F.lit(1.0))
