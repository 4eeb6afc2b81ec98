"""Measures along lines and tracks: consecutive points, turns, grades, sessions and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def pairs(points: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each point with the next one's columns (next_...), null for a line's last."""
    w = Window.partitionBy(*key).orderBy(order)
    return points.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))


def reversals(points: DataFrame, key: list[str], order: str, x: str = "x", y: str = "y", degrees: float = 120.0) -> DataFrame:
    """(key, reversals): places where the heading turns by at least some degrees between one step and the next; standing still is no step."""
    w = Window.partitionBy(*key).orderBy(order)
    step = lambda c, k: F.lead(c, k + 1).over(w) - F.lead(c, k).over(w) if k else F.lead(c).over(w) - F.col(c)
    p = points.select(*key, step(x, 0).alias("ax"), step(y, 0).alias("ay"), step(x, 1).alias("bx"), step(y, 1).alias("by"))
    turn = (F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")) / F.sqrt((F.pow("ax", F.lit(2)) + F.pow("ay", F.lit(2))) * (F.pow("bx", F.lit(2)) + F.pow("by", F.lit(2))))
    moving = ((F.col("ax") != 0) | (F.col("ay") != 0)) & ((F.col("bx") != 0) | (F.col("by") != 0))
    sharp = F.when(moving, turn <= F.cos(F.radians(F.lit(degrees))) + 1e-9)
    return p.groupBy(*key).agg(F.count_if(F.coalesce(sharp, F.lit(False))).alias("reversals"))


def grades(samples: DataFrame, key: list[str], order: str, z: str, spacing: float = 25.0, step: float = 50.0) -> DataFrame:
    """Samples of a line every `spacing` metres with the grade over the next `step` metres, null where the line ends before."""
    w = Window.partitionBy(*key).orderBy(order)
    return samples.withColumn("grade", (F.lead(z, int(step / spacing)).over(w) - F.col(z)) / step)


def deltas(fixes: DataFrame, key: list[str], segment: str, order: str, time: str) -> DataFrame:
    """Fixes with the time since the one before in their segment; null for a segment's first."""
    w = Window.partitionBy(*key, segment).orderBy(order)
    return fixes.withColumn("dt", F.col(time) - F.lag(time).over(w))


def sessions(fixes: DataFrame, key: list[str], segment: str, time: str, gap: int = 30_000) -> DataFrame:
    """(key, sessions, fixes): a session ends with its segment and at a gap in time."""
    w = Window.partitionBy(*key).orderBy(time)
    new = ~F.lag(segment).over(w).eqNullSafe(F.col(segment)) | (F.col(time) - F.lag(time).over(w) > gap)
    marked = fixes.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    return marked.groupBy(*key).agg(F.sum("_new").alias("sessions"), F.count("*").alias("fixes"))


def stations(length: Column, step: int = 25) -> Column:
    """Distances along a line at which it is sampled, from its start to before its end."""
    at = F.sequence(F.lit(0).cast("bigint"), F.ceil(length).cast("bigint"), F.lit(step).cast("bigint"))
    return F.filter(at, lambda d: d < length)


def accuracy_circle(lon: Column, lat: Column, metres: Column, corners: int = 64) -> Column:
    """A closed ring of (lon, lat) at a distance from a place, the first corner north of it."""
    y, d = F.radians(lat), metres / EARTH_M

    def corner(i: Column) -> Column:
        b = F.radians(i * 360.0 / corners)
        north = F.asin(F.sin(y) * F.cos(d) + F.cos(y) * F.sin(d) * F.cos(b))
        east = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(y), F.cos(d) - F.sin(y) * F.sin(north))
        return F.struct(F.degrees(east).alias("lon"), F.degrees(north).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(corners)), corner)


def moving_time_text(seconds: Column) -> Column:
    """Hours, minutes and seconds, the last two of two digits."""
    s = F.floor(seconds).cast("bigint")
    two = lambda v: F.lpad(F.floor(v).cast("string"), 2, "0")
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), two(s % 3600 / 60), two(s % 60))


def finite(value: Column) -> Column:
    """A number, or null where it is none or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
