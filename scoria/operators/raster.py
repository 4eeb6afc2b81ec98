"""Raster stencils in long form (id, r, c, v): joins on shifted cells, checkable as SQL, or higher-order
functions over a row-major array where a block fits in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(df: DataFrame, id_col: str, array_col: str, width: int, scale: float = 1000) -> DataFrame:
    """Cells (id, r, c, v) of a row-major array, values scaled and rounded to whole numbers."""
    x = df.select(F.col(id_col).alias("id"), F.posexplode(array_col).alias("i", "e"))
    return x.select("id", F.floor(F.col("i") / width).cast("int").alias("r"), (F.col("i") % width).alias("c"), F.floor(F.col("e").cast("double") * scale + 0.5).cast("bigint").alias("v"))


def crossings(cells: DataFrame, interval: int) -> DataFrame:
    """Contour crossings of each cell edge: (id, r, c, side, level), side h to the east, v to the south.

    The neighbours come from one window each, within (id, r) and (id, c): no join.
    Level 0 is left out; an edge with equal ends has none.
    """
    east = F.lead("v").over(Window.partitionBy("id", "r").orderBy("c"))
    south = F.lead("v").over(Window.partitionBy("id", "c").orderBy("r"))
    sides = F.array(F.struct(F.lit("h").alias("side"), F.col("e").alias("w")), F.struct(F.lit("v").alias("side"), F.col("s").alias("w")))
    x = cells.withColumn("e", east).withColumn("s", south).withColumn("x", F.explode(sides)).filter("x.w is not null and x.w <> v")
    lo, hi = F.least("v", "x.w"), F.greatest("v", "x.w")
    first, last = F.ceil(lo / interval), F.ceil(hi / interval) - 1
    x = x.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    return x.filter("k <> 0").select("id", "r", "c", "x.side", (F.col("k") * interval).alias("level"))


def bilinear(a: Column, b: Column, c: Column, d: Column, fx: Column, fy: Column) -> Column:
    """Value between four corners: a, b on top, c, d below."""
    return a * (1 - fx) * (1 - fy) + b * fx * (1 - fy) + c * (1 - fx) * fy + d * fx * fy


def disk_sum(cells: DataFrame, radius: int) -> DataFrame:
    """Sum of the values within a radius of each cell: scattered to the disk and added up, map-side first."""
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    d = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets)))
    spread = cells.select("id", "r", "c", "v", d.alias("d")).select("id", (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c"), "v")
    return spread.groupBy("id", "r", "c").agg(F.sum("v").alias("s")).join(cells.select("id", "r", "c"), ["id", "r", "c"], "left_semi")


def terrarium(metres: Column) -> Column:
    """struct(red, green, blue) of an elevation, at a 256th of a metre; half to even."""
    n = F.rint(F.greatest(F.lit(0.0), F.least(metres + 32768, F.lit(65535.996))) * 256).cast("bigint")
    byte = lambda s: F.shiftright(n, s).bitwiseAND(F.lit(255).cast("bigint"))
    return F.struct(byte(16).alias("red"), byte(8).alias("green"), byte(0).alias("blue"))


def from_terrarium(red: Column, green: Column, blue: Column) -> Column:
    return red * 256 + green + blue / 256 - 32768


def chunk_keys(x0: Column, x1: Column, y0: Column, y1: Column, chunk: int = 1024, halo: int = 2) -> Column:
    """Array of struct(cx, cy): the chunks that a window with its halo needs."""
    xs = F.sequence(F.floor((x0 - halo) / chunk), F.floor((x1 + halo - 1) / chunk))
    ys = F.sequence(F.floor((y0 - halo) / chunk), F.floor((y1 + halo - 1) / chunk))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def mosaic(chunks: DataFrame, key: list[str], side: int, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """(key, r, c, v) of a window, both ends with it, over chunks (cy, cx, r, c, v) of a side each."""
    at = chunks.select(*key, (F.col("cy") * side + F.col("r")).alias("r"), (F.col("cx") * side + F.col("c")).alias("c"), "v")
    return at.filter(F.col("r").between(*rows) & F.col("c").between(*columns))


def resampled(cells: DataFrame, fx: float, fy: float, coarse: DataFrame) -> DataFrame:
    """(id, r, c, v): the value a part of a cell east and south of each, between its four neighbours, where all four cells are in the grid.

    A missing neighbour leaves no value of its own; there the coarse one (id, coarse) is taken.
    """
    east = F.lead(F.struct("v")).over(Window.partitionBy("id", "r").orderBy("c"))
    row = cells.withColumn("_e", east).withColumn("_row", F.struct(F.col("v"), F.col("_e")))
    south = F.lead("_row").over(Window.partitionBy("id", "c").orderBy("r"))
    four = row.withColumn("_s", south).filter("_e is not null and _s is not null")
    v = bilinear(F.col("v"), F.col("_e.v"), F.col("_s.v"), F.col("_s._e.v"), F.lit(fx), F.lit(fy))
    return four.select("id", "r", "c", v.alias("fine")).join(coarse, "id", "left").select("id", "r", "c", F.coalesce("fine", "coarse").alias("v"))
