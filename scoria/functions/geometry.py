"""Geometry columns over WKB: JVM functions on the geometry library that Spark ships."""

from __future__ import annotations

import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

JAR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jvm", "kernels.jar")
PORTION = "struct<id:string,agency:string,class:string,tied:boolean,also:array<string>,shape:binary>"
#: Functions by name, with the type that each gives.
FUNCTIONS = {
    "FromText": "binary", "AsText": "string", "Length": "double", "Area": "double", "Distance": "double", "Hausdorff": "double", "WithinLength": "double",
    "Intersection": "binary", "Difference": "binary", "Covers": "boolean", "Buffer": "binary", "Union": "binary", "MergeLines": "binary", "Lines": "array<binary>",
    "Polygons": "array<binary>", "RepairArea": "binary", "Clip": "binary", "Affine": "binary", "Boundary": "binary", "Rounded": "binary", "LabelCenter": "binary",
    "Axis": "struct<length:double,width:double,angle:double>", "Relation": "binary", "CoastWater": "binary", "Wrap": "binary", "Resample": "array<binary>",
    "Bounds": "binary", "Project": "binary", "Unproject": "binary", "RoundOrient": "binary", "Developed": "boolean", "Outline": "binary", "Conflate": f"array<{PORTION}>",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; done once for each."""
    if spark.catalog.functionExists("g_conflate"):
        return
    from pyspark.sql.types import _parse_datatype_string

    spark.sql(f"ADD JAR '{JAR}'")
    for name, kind in FUNCTIONS.items():
        spark.udf.registerJavaFunction(f"g_{name.lower()}", f"scoria.Udfs${name}", _parse_datatype_string(kind))


def g(name: str, *args) -> Column:
    """A geometry function of columns and plain values."""
    return F.call_function(f"g_{name.lower()}", *(a if isinstance(a, Column) else F.lit(a) for a in args))


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A rectangle."""
    text = F.format_string("POLYGON((%1$s %2$s, %3$s %2$s, %3$s %4$s, %1$s %4$s, %1$s %2$s))", *(c.cast("double").cast("string") for c in (west, south, east, north)))
    return g("FromText", text)


def line(points: Column) -> Column:
    """A line through an array of struct(x, y)."""
    return g("FromText", F.concat(F.lit("LINESTRING("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")")))


def union_agg(shapes: Column) -> Column:
    """Union of a group's shapes; for groups that may be large, union by a salt first (see dissolve)."""
    return g("Union", F.collect_list(shapes))
