"""The line network of tiles: world and local coordinates, the order of sources, what each zoom shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mercator as m
from ..functions.geometry import g, register
from ..functions.names import display_name, route_ref
from . import shapes

#: Metres around the globe on the Mercator world.
AROUND_M = 40075016.68557849
# Sources in the order in which they are added; the first zoom with single lines and the first with the network; tile edges in 512ths.
SOURCE_ORDER = {"PCTA": 0, "NPS": 1, "USFS": 2, "MVUM trails": 3, "MVUM roads": 4}
LINES_ZOOM, NETWORK_ZOOM = 11, 13
CONTEXT, EDGE = 64, 8


def _matrix(*values) -> Column:
    return F.array(*((v if isinstance(v, Column) else F.lit(v)).cast("double") for v in values))


def scale_m(y: Column, z: Column) -> Column:
    """Metres of the whole Mercator world at the middle latitude of a tile."""
    return AROUND_M * F.cos(F.radians(m.inverse_lat((y + 0.5) / F.pow(F.lit(2.0), z))))


def to_metres(shape: Column, z: Column, x: Column, y: Column) -> Column:
    """A shape in world coordinates as metres from its tile's corner."""
    n, s = F.pow(F.lit(2.0), z), scale_m(y, z)
    return g("Affine", shape, _matrix(s, 0, -x / n * s, 0, s, -y / n * s))


def to_world(shape: Column, z: Column, x: Column, y: Column) -> Column:
    """The inverse of to_metres."""
    n, s = F.pow(F.lit(2.0), z), scale_m(y, z)
    return g("Affine", shape, _matrix(1 / s, 0, x / n, 0, 1 / s, y / n))


def map_network(features: DataFrame, extent: int = 4096) -> DataFrame:
    """Features of map tiles (z, x, y, id, name, shape in tile units) in world coordinates, with ids of their own and their route."""
    register(features.sparkSession)
    n = F.pow(F.lit(2.0), F.col("z"))
    shape = g("Affine", F.col("shape"), _matrix(1 / (extent * n), 0, F.col("x") / n, 0, 1 / (extent * n), F.col("y") / n))
    ident = F.concat_ws("-", F.lit("osm"), "z", "x", "y", F.col("id").cast("string"))
    return features.select("z", "x", "y", ident.alias("id"), F.lit("OpenStreetMap").alias("agency"), "name", route_ref(F.col("name")).alias("route_ref"), shape.alias("shape"))


def _clip(shape: Column, z: Column, x: Column, y: Column, edge: int) -> Column:
    from ..functions.geometry import box

    n = F.pow(F.lit(2.0), z)
    return g("Clip", shape, box(x / n, y / n, (x + 1) / n, (y + 1) / n), F.lit(edge / 512.0) / n, 0.0, "line")


def compose(lines: DataFrame) -> DataFrame:
    """(z, x, y, layer, id, agency, class, name, display_name, tied, also, shape): what each tile shows of its lines.

    `lines` has z, x, y, source and LINE_COLUMNS with shapes in world coordinates; the map's lines are references. Lines
    are cut to the tile with some context, put in metres, conflated in the order of sources, put back and cut to the tile's
    edge. Routes are conflated by themselves, one by one; below zoom 11 they are all that is shown, below 13 forest roads
    beside them, and from 13 on the network.
    """
    register(lines.sparkSession)
    tile, at = ["z", "x", "y"], [F.col(c) for c in ("z", "x", "y")]
    order = F.coalesce(F.create_map(*(F.lit(v) for kv in SOURCE_ORDER.items() for v in kv))[F.col("source")], F.lit(9))
    near = lines.withColumn("shape", _clip(F.col("shape"), *at, CONTEXT)).filter("shape is not null").withColumn("shape", to_metres(F.col("shape"), *at))
    by = [order, F.col("id")]
    routes = near.filter(~F.col("reference") & (F.coalesce("route_ref", F.lit("")) != ""))
    routes = shapes.conflate(routes, [*tile, "route_ref"], by).drop("route_ref").withColumn("layer", F.lit("routes"))
    full = shapes.conflate(near.filter(F.col("z") >= LINES_ZOOM), tile, by)
    road = near.select(*tile, "id", "agency", F.col("kind")).distinct()
    full = full.join(road, [*tile, "id", "agency"], "left")
    network = full.filter(F.col("z") >= NETWORK_ZOOM).withColumn("layer", F.lit("network"))
    roads = full.filter((F.col("z") < NETWORK_ZOOM) & (F.col("kind") == "forest_road")).withColumn("layer", F.lit("roads"))
    out = routes.unionByName(network.drop("kind")).unionByName(roads.drop("kind"))
    names = near.groupBy(*tile, "id", "agency").agg(F.first("name", True).alias("name"))
    out = out.join(names, [*tile, "id", "agency"], "left")
    out = out.withColumn("shape", _clip(to_world(F.col("shape"), *at), *at, EDGE)).filter("shape is not null")
    shown = display_name(F.col("name"))
    return out.select(*tile, "layer", "id", "agency", "class", "name", F.when(shown != F.col("name"), shown).alias("display_name"), "tied", "also", "shape")


def developed(places: DataFrame, buildings: DataFrame, id_: str = "id", cell: float = 500.0) -> DataFrame:
    """(id, developed): whether places (id, x, y in metres) are among buildings (shape, in metres).

    Buildings go to every cell within 150 m of them, so that a place meets each once; a place has the
    buildings of its surroundings only.
    """
    register(places.sparkSession)
    edges = F.split(F.regexp_replace(g("AsText", g("Bounds", F.col("shape"))), "[^0-9.E -]+", " "), " +")
    b = buildings.select("shape").distinct().withColumn("e", F.transform(F.filter(edges, lambda v: v != ""), lambda v: v.cast("double")))
    xs, ys = F.filter("e", lambda v, i: i % 2 == 0), F.filter("e", lambda v, i: i % 2 == 1)
    span = lambda v: F.explode(F.sequence(F.floor((F.array_min(v) - 150) / cell), F.floor((F.array_max(v) + 150) / cell)))
    b = b.withColumn("cx", span(xs)).withColumn("cy", span(ys)).select("cx", "cy", "shape")
    p = places.select(id_, "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    point = g("FromText", F.format_string("POINT(%s %s)", F.col("x").cast("double").cast("string"), F.col("y").cast("double").cast("string")))
    near = p.join(b, ["cx", "cy"]).filter(g("Distance", point, F.col("shape")) <= 150).groupBy(id_, "x", "y").agg(F.collect_set("shape").alias("near"))
    hit = near.select(id_, g("Developed", F.col("x").cast("double"), F.col("y").cast("double"), F.col("near")).alias("developed"))
    return places.select(id_).distinct().join(hit, id_, "left").withColumn("developed", F.coalesce("developed", F.lit(False)))
