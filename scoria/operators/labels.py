"""Labels and symbols on the map: where they fit and how coincident ones are set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Zooms looked through in tenths, pixels of a tile, width of a letter in ems, and the font's size.
FIRST, LAST, TILE_PX, EM, FONT_PX = 50, 220, 512, 0.68, 12.0


def label_zoom(width: Column, name: Column, font: float = FONT_PX) -> Column:
    """The first zoom at which a name fits into a width of the world, by tenths; null where none does."""
    need = F.length(name) * EM * font
    z = F.filter(F.sequence(F.lit(FIRST), F.lit(LAST)), lambda z: width * F.pow(F.lit(2.0), z / 10.0) * TILE_PX >= need)
    return F.get(z, F.lit(0)) / 10.0


def apart(symbols: DataFrame, x: Column, y: Column, size: float = 20.0) -> DataFrame:
    """Symbols with their slot and offset (dx, dy) in pixels: those at one place go along a spiral on which none overlaps the one before.

    The first stays; the k-th is turned by the golden angle and lies size times the root of k away.
    """
    at = F.row_number().over(Window.partitionBy("_x", "_y").orderBy("id")) - 1
    out = symbols.withColumn("_x", x).withColumn("_y", y).withColumn("slot", at).drop("_x", "_y")
    angle, away = F.col("slot") * 2.399963229728653, F.sqrt(F.col("slot").cast("double")) * size
    return out.withColumn("dx", away * F.cos(angle)).withColumn("dy", away * F.sin(angle))
