"""Quadtree operators: covers, halos, ancestors, coverage rectangles and enumeration.

All are explodes over computed ranges and equi-joins on tile keys; nothing iterates on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mercator import morton, tile_x, tile_y


def cover(df: DataFrame, z: int, west: str = "west", south: str = "south", east: str = "east", north: str = "north") -> DataFrame:
    """Each row once for each tile (z, x, y) that its bounds touch."""
    xs = F.sequence(tile_x(F.col(west), z), tile_x(F.col(east), z))
    ys = F.sequence(tile_y(F.col(north), z), tile_y(F.col(south), z))
    return df.withColumn("z", F.lit(z)).withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))


def assign(df: DataFrame, z: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Each point row with the one tile that owns it; edges belong to the tile east and south of them."""
    return df.withColumn("z", F.lit(z)).withColumn("x", tile_x(F.col(lon), z)).withColumn("y", tile_y(F.col(lat), z))


def halo(tiles: DataFrame, rings: int = 1, wrap: bool = False) -> DataFrame:
    """Distinct tiles with their neighbours, kept inside the world; with wrap, x goes round it."""
    d = F.sequence(F.lit(-rings), F.lit(rings))
    side = F.expr("shiftleft(1L, z)")
    out = tiles.select("z", "x", "y", F.explode(d).alias("dx")).withColumn("dy", F.explode(d))
    x = F.pmod(F.col("x") + F.col("dx"), side) if wrap else F.col("x") + F.col("dx")
    out = out.select("z", x.alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    return out.filter((F.col("x") >= 0) & (F.col("x") < side) & (F.col("y") >= 0) & (F.col("y") < side)).distinct()


def ancestors(tiles: DataFrame, lowest: int) -> DataFrame:
    """Distinct tiles at every zoom from `lowest` to just above each tile that hold it."""
    up = F.explode(F.sequence(F.lit(1), F.col("z") - lowest)).alias("k")
    out = tiles.filter(F.col("z") > lowest).select("z", "x", "y", up)
    return out.select((F.col("z") - F.col("k")).alias("z"), F.expr("shiftright(x, k)").alias("x"), F.expr("shiftright(y, k)").alias("y")).distinct()


def descendants(tiles: DataFrame, levels: int) -> DataFrame:
    """The 4**levels tiles below each tile."""
    n = (1 << levels) - 1
    d = F.sequence(F.lit(0), F.lit(n))
    out = tiles.select("z", "x", "y", F.explode(d).alias("i")).withColumn("j", F.explode(d))
    return out.select(
        (F.col("z") + levels).alias("z"), (F.shiftleft("x", levels) + F.col("i")).alias("x"), (F.shiftleft("y", levels) + F.col("j")).alias("y")
    )


def rectangles(tiles: DataFrame) -> DataFrame:
    """Runs of neighbouring tiles in a row as (z, x0, y, x1): gaps and islands."""
    run = F.col("x") - F.row_number().over(Window.partitionBy("z", "y").orderBy("x"))
    return (
        tiles.select("z", "x", "y").distinct().withColumn("run", run).groupBy("z", "y", "run")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select("z", "x0", "y", "x1")
    )


def quadtree_keys(bounds: DataFrame, z: int, after: int = -1) -> DataFrame:
    """Distinct tiles that any of the bounds touches, with Morton codes beyond `after`: a resumable order."""
    keys = cover(bounds, z).select("z", "x", "y").distinct().withColumn("code", morton(F.col("x"), F.col("y")))
    return keys.filter(F.col("code") > after)


def tile_count(z: int, west: Column, south: Column, east: Column, north: Column) -> Column:
    """How many tiles bounds touch, without making them."""
    return (tile_x(east, z) - tile_x(west, z) + 1) * (tile_y(south, z) - tile_y(north, z) + 1)


def covered_pairs(points: DataFrame, boxes: DataFrame, z: int, box_id: str) -> DataFrame:
    """Range join of points and boxes: an equi-join on tiles with the bounds as residual."""
    b = cover(boxes, z).select(F.col(box_id), "x", "y", "west", "south", "east", "north")
    p = assign(points, z)
    return p.join(b, ["x", "y"]).filter(
        F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    )
