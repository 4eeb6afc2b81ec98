"""Queries of readers, sinks and streams: tables are written to the session's checkpoint folder in each format and read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions.geometry import g, register
from ..operators import canonical, classify, match, shapes
from ..session import checkpoint_dir, store, table
from ..sources import readers, tiles
from ..streaming import track
from .registry import ORACLE, query
from .shapes import _areas, _round
from .tracks import fixes

c = F.col


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/scoria-{uuid.uuid4().hex}"


def _written(df, form: str, **options) -> str:
    path = _folder(df.sparkSession)
    df.write.options(**options).format(form).save(path)
    return path


def _land(spark, sf, agency):
    return table(spark, sf, "landmarks").filter(c("agency") == agency).select("id", "feature_id", "name", "feature_class", "prim_lat_dec", "prim_long_dec", "lon", "lat", "elevation_m").distinct()


_KEPT = "['Summit', 'Gap', 'Spring', 'Falls', 'Arch', 'Pillar', 'Cave']"
_KINDS = "['summit', 'pass', 'spring', 'waterfall', 'arch', 'rock', 'cave']"
_INSIDE = "between -180 and 180 and ({0} <= -60 or {0} >= 170) and {1} between 18 and 72"


@query("src10_gnis", f"""with g as (select distinct id, feature_id, name, feature_class as k, try_cast(prim_long_dec as double) as x, try_cast(prim_lat_dec as double) as y, prim_long_dec, prim_lat_dec, lon, lat, elevation_m from landmarks where agency = 'USGS GNIS')
  select 'gnis:' || feature_id as id, name, {_KINDS}[list_position({_KEPT}, k)] as kind, count(*) as n from g where list_contains({_KEPT}, k) and name <> '' and not contains(lower(name), '(historical)') and x {_INSIDE.format('x', 'y')} group by 1, 2, 3""")
def _(spark, sf):
    rows = _land(spark, sf, "USGS GNIS").select("feature_id", c("name").alias("feature_name"), "feature_class", "prim_lat_dec", "prim_long_dec")
    path = _written(rows, "csv", sep="|", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.gnis_points(readers.read_gnis(spark, path)).groupBy("id", "name", "kind").agg(F.count("*").alias("n"))


@query("src11_geonames", f"""with g as (select distinct id, name, lon, lat, elevation_m from landmarks where agency = 'GeoNames' and name is not null and name <> '' and not regexp_matches(name, '[\\t\\n\\r"\\\\]') and lon is not null and lat is not null)
  select 'geonames:' || id as id, name, count(*) as n from g where not contains(lower(name), '(historical)') and lon {_INSIDE.format('lon', 'lat')} group by 1, 2""")
def _(spark, sf):
    r = table(spark, sf, "landmarks").filter("agency = 'GeoNames' and name <> '' and lon is not null and lat is not null").filter(~c("name").rlike(r'[\t\n\r"\\]')).select("id", "name", "lon", "lat", "elevation_m").distinct()
    none = F.lit("")
    fields = [c("id"), c("name"), none, none, c("lat").cast("string"), c("lon").cast("string"), F.lit("T"), F.lit("MT"), F.lit("US"), none, none, none, none, none, none, F.coalesce(c("elevation_m").cast("int").cast("string"), none), none, none, none]
    path = _written(r.select(F.concat_ws("\t", *fields).alias("value")), "text")
    return readers.geonames_points(readers.read_geonames(spark, path)).groupBy("id", "name").agg(F.count("*").alias("n"))


@query("src12_facilities", f"""with f as (select distinct id, name, kind, lon, lat, enabled from facilities where name is not null and name <> '')
  select 'ridb:' || id as id, name, count(*) as n from f where enabled and lon {_INSIDE.format('lon', 'lat')} group by 1, 2""")
def _(spark, sf):
    f = table(spark, sf, "facilities").filter("name <> ''").select("id", "name", "kind", "lon", "lat", "enabled").distinct()
    rows = f.select(c("id").alias("FacilityID"), c("name").alias("FacilityName"), c("kind").alias("FacilityTypeDescription"), c("lon").alias("FacilityLongitude"), c("lat").alias("FacilityLatitude"), c("enabled").alias("Enabled"))
    path = _written(rows, "csv", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_facilities(spark, path).groupBy("id", "name").agg(F.count("*").alias("n"))


@query("src13_geojson", "select area_id, 'Polygon' as type, name from areas where name is not null")
def _(spark, sf):
    a = table(spark, sf, "areas").filter("name is not null")
    ring = F.array(*(F.array(c(x), c(y)) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))))
    feature = F.struct(F.lit("Feature").alias("type"), c("area_id").cast("string").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("name").alias("properties"))
    # The areas are a fixed table: one collection in one file.
    text = a.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    path = _written(text, "text", compression="gzip")
    return readers.read_geojson(spark, path, "name string").select(c("id").cast("int").alias("area_id"), "type", c("properties.name").alias("name"))


@query("src14_poly", "select 4 as points, count(*) as rings from areas")
def _(spark, sf):
    at = lambda x, y: F.concat_ws(" ", F.lit("  "), c(x).cast("string"), c(y).cast("string"))
    text = F.concat_ws("\n", F.concat(F.lit("area_"), c("area_id").cast("string")), F.lit("1"), at("west", "south"), at("east", "south"), at("east", "north"), at("west", "north"), F.lit("END"), F.lit("END"))
    path = _written(table(spark, sf, "areas").select(text.alias("value")).repartition(8), "text")
    return readers.read_poly(spark, path).groupBy(F.size("points").alias("points")).agg(F.count("*").alias("rings"))


@query("src22_fix_log", "select user_id as segment, count(*) filter (event_id % 10 <> 0) as good, (select count(*) from events where event_id % 10 = 0) as bad from events group by 1")
def _(spark, sf):
    """A log of which every tenth line is torn."""
    e = table(spark, sf, "events")
    line = F.to_json(F.struct((c("event_id") % 100).cast("double").alias("x"), (c("event_id") % 50).cast("double").alias("y"), c("event_id").alias("time"), c("user_id").alias("segment")))
    torn = F.when(c("event_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line)
    good, bad = readers.read_fixes(spark, _written(e.select(torn.alias("value")), "text"))
    out = good.groupBy("segment").agg(F.count("*").alias("good"))
    n = bad.count()
    return out.withColumn("bad", F.lit(n).cast("bigint"))


@query("snk09_packed", "select doc_id, sha256(text) as sha from documents where text is not null")
def _(spark, sf):
    """Hashes of texts that were packed and unpacked again."""
    import gzip
    import hashlib

    def run(batches):
        for pdf in batches:
            blobs = [tiles.packed(t.encode())[0] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sha": [hashlib.sha256(gzip.decompress(b)).hexdigest() for b in blobs]})

    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text")
    return d.mapInPandas(run, "doc_id bigint, sha string")


@query("l10_release", "select kind, count(*) as n from landmarks where kind is not null group by 1")
def _(spark, sf):
    """The release that the pointer names after two were published and the first was tried again."""
    root = _folder(spark)
    kinds = table(spark, sf, "landmarks").filter("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))
    old = kinds.withColumn("n", c("n") + 1)
    tiles.publish(store(old), root, "r1")
    tiles.publish(store(kinds), root, "r2")
    return tiles.current(spark, root)


def _streamed(spark, sf, batches: int):
    """Totals of each device from a stream of files, in parts by time, the last state of each."""
    f = fixes(spark, sf).withColumn("part", F.ntile(batches).over(track.Window.partitionBy("device").orderBy("time_ms")))
    live, out = _folder(spark), _folder(spark)
    f = store(f)
    schema = f.drop("part").schema

    def keep(df, n):
        df.withColumn("n", F.lit(n)).write.mode("append").parquet(out)

    for k in range(1, batches + 1):
        f.filter(c("part") == k).drop("part").write.mode("append").parquet(live)
        totals = track.stream_track_stats(spark.readStream.schema(schema).parquet(live))
        q = totals.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", live + "-state").trigger(availableNow=True).start()
        q.awaitTermination()
    last = spark.read.parquet(out).groupBy("device").agg(F.max_by(F.struct("distance", "moving_s", "gain", "points"), "points").alias("t"))
    return last.select("device", F.floor(c("t.distance") * 100 + 1e-6).alias("distance"), c("t.moving_s").cast("bigint").alias("moving_s"), c("t.gain").cast("bigint").alias("gain"), c("t.points").alias("points"))


@query("st02_replay", ORACLE["st01_track_stats"])
def _(spark, sf):
    """The stream's totals over two restarts equal those of the whole log."""
    return _streamed(spark, sf, 2)


@query("agg26_totals", f"select cast(sum(points) as bigint) as points, cast(sum(moving_s) as bigint) as moving_s, cast(sum(gain) as bigint) as gain from ({ORACLE['st01_track_stats']})")
def _(spark, sf):
    t = track.track_stats(fixes(spark, sf))
    return t.agg(F.sum("points").alias("points"), F.sum("moving_s").cast("bigint").alias("moving_s"), F.sum(F.col("gain").cast("bigint")).alias("gain"))


def _places(spark, sf, precedence):
    """Records of places five kilometres apart, three of each fifty metres apart under one name.

    After 300,000 places, at 80 degrees, their rows begin again in the south, where other names hold the positions.
    """
    place = F.floor(c("p_partkey") / 3)
    return match.keyed(table(spark, sf, "part").select(
        c("p_partkey").cast("string").alias("id"), F.concat(F.lit("Place "), place.cast("string")).alias("name"), F.lit("summit").alias("kind"), (-120 + place % 300 * 0.05 + c("p_partkey") % 3 * 0.0005).alias("lon"),
        (30 + F.floor(place / 300) % 1000 * 0.05).alias("lat"), F.lit(None).cast("string").alias("gnis_id"), F.lit(False).alias("match_ambiguous"), precedence.alias("precedence"),
    ))


def _first_sql(order: str) -> str:
    return f"select cast(p_partkey as varchar) as id, first_value(cast(p_partkey as varchar)) over (partition by p_partkey // 3 order by {order}, cast(p_partkey as varchar)) as canonical from part"


@query("j07_dedupe", _first_sql("(p_partkey * 7) % 5"))
def _(spark, sf):
    return canonical.canonicalize(_places(spark, sf, (c("p_partkey") * 7) % 5)).select("id", "canonical")


@query("j21_client_order", _first_sql("p_partkey % 2, (p_partkey * 7) % 5"))
def _(spark, sf):
    """Visible records first, then by precedence."""
    return canonical.canonicalize(_places(spark, sf, c("p_partkey") % 2 * 10 + (c("p_partkey") * 7) % 5)).select("id", "canonical")


@query("b06_unaltered", "select area_id, cast(round((east - west) * (north - south) * 1e6) as bigint) as a from areas where kind in ('park', 'wilderness', 'forest')")
def _(spark, sf):
    """Areas beside their strokes, all in one cell: shapes are never altered."""
    a = _areas(spark, sf).filter("kind in ('park', 'wilderness', 'forest')").withColumn("cell", F.lit(1))
    return shapes.outlines(a, ["cell"], 1 / 111_320).select("area_id", _round(g("Area", c("shape")), 1e6).alias("a"))


@query("b05_line_parts", "select kind, count(*) as parts from areas group by 1")
def _(spark, sf):
    a = _areas(spark, sf)
    move = F.array(*(x.cast("double") for x in (F.lit(1), F.lit(0), c("area_id") * 1000, F.lit(0), F.lit(1), F.lit(0))))
    many = a.groupBy("kind").agg(g("Boundary", g("Union", F.collect_list(g("Affine", c("shape"), move)))).alias("edge"))
    return many.withColumn("part", F.explode(g("Lines", c("edge")))).groupBy("kind").agg(F.count("*").alias("parts"))


@query("b01_beside_park", "select p_partkey, cast(case when d < 250 then 60000 - 10000 - 2 * (250 - d) else 60000 end as bigint) as stroke from (select p_partkey, p_partkey % 12 * 30 as d from part)")
def _(spark, sf):
    """A forest east of a park, 0 to 330 m apart: within 250 m its side and what rounds the corners is no stroke."""
    register(spark)
    p, d = table(spark, sf, "part"), c("p_partkey") % 12 * 30
    rect = lambda w, e: F.format_string("POLYGON((%1$s 0, %2$s 0, %2$s 10000, %1$s 10000, %1$s 0))", w.cast("string"), e.cast("string"))
    park = p.select("p_partkey", F.lit(1).alias("area_id"), F.lit("park").alias("kind"), g("FromText", rect(F.lit(0), F.lit(20000))).alias("shape"))
    forest = p.select("p_partkey", F.lit(2).alias("area_id"), F.lit("forest").alias("kind"), g("FromText", rect(d + 20000, d + 40000)).alias("shape"))
    return shapes.outlines(park.unionByName(forest), ["p_partkey"], 1.0).filter("area_id = 2").select("p_partkey", _round(g("Length", c("stroke")), 1).alias("stroke"))


def _two_lines(spark, sf, reference, adding, columns: dict):
    """A reference and an addition for each part, conflated in a cell of their own."""
    register(spark)
    none = F.lit(None).cast("string")
    base = {"name": F.lit(""), "class": F.lit("residential"), "kind": F.lit("road"), "route_ref": none, "ref": none, "surface": none, "bridge": F.lit(False), "tunnel": F.lit(False)}

    def side(agency, ident, is_reference, text, own):
        cols = {**base, **own}
        return table(spark, sf, "part").select("p_partkey", F.lit(ident).alias("id"), F.lit(agency).alias("agency"), *(v.alias(k) for k, v in cols.items()), F.lit(is_reference).alias("reference"), g("FromText", text).alias("shape"))

    both = side("OpenStreetMap", "r", True, reference, columns.get("r", {})).unionByName(side("USFS", "a", False, adding, columns.get("a", {})))
    out = shapes.conflate(both, ["p_partkey"], [c("id")])
    left = F.sum(F.when(c("id") == "a", g("Length", c("shape"))).otherwise(0.0))
    along = F.sum(F.when((c("id") == "r") & (F.size("also") > 0), g("Length", c("shape"))).otherwise(0.0))
    return out.groupBy("p_partkey").agg(_round(left, 100).alias("left100"), _round(along, 100).alias("along100"))


_LEVEL = lambda y: F.format_string("LINESTRING(0 %1$s, 1000 %1$s)", y.cast("string"))


@query("c05_widths", """select p_partkey, cast(case when d <= case when k = 0 then 15 when k = 1 then 2.5 else 5 end then 0 else 100000 end as bigint) as left100,
    cast(case when d <= case when k = 0 then 15 when k = 1 then 2.5 else 5 end then 100000 else 0 end as bigint) as along100 from (select p_partkey, p_partkey % 20 as d, p_partkey % 3 as k from part)""")
def _(spark, sf):
    """Level lines 0 to 19 m apart under one name in two spellings, under two names, and without one."""
    k = c("p_partkey") % 3
    name = F.when(k == 0, "Mtn Ridge Rd").when(k == 1, "Other Road").otherwise("")
    return _two_lines(spark, sf, F.lit("LINESTRING(0 0, 1000 0)"), _LEVEL(c("p_partkey") % 20), {"r": {"name": F.lit("Mountain Ridge Road")}, "a": {"name": name}})


@query("c04_compatible", "select p_partkey, cast(case when p_partkey % 2 = 0 or not (p_partkey % 3 <> 1 or p_partkey % 5 = 0) then 100000 else 0 end as bigint) as left100, cast(case when p_partkey % 2 = 0 or not (p_partkey % 3 <> 1 or p_partkey % 5 = 0) then 0 else 100000 end as bigint) as along100 from part")
def _(spark, sf):
    """Lines a metre apart: every second on a bridge, every third a path beside a track, of which every fifth is for motors."""
    n = c("p_partkey")
    own = {"bridge": n % 2 == 0, "class": F.when(n % 3 == 1, "path").otherwise("track"), "kind": F.when((n % 3 == 1) & (n % 5 == 0), "motorized_trail").otherwise("road")}
    return _two_lines(spark, sf, F.lit("LINESTRING(0 0, 1000 0)"), F.lit("LINESTRING(0 1, 1000 1)"), {"r": {"class": F.lit("track")}, "a": own})


@query("c06_confirmed", """select p_partkey, cast(case when p_partkey % 2 = 0 then 0 else round((660 + sqrt(pow(340 - (300 + 40 * 1.5 / 39), 2) + 1600)) * 100) end as bigint) as left100 from part""")
def _(spark, sf):
    """A trail tight on the map's for 300 m and 40 m off for the rest: it is that trail, unless the numbers contradict."""
    number = F.when(c("p_partkey") % 2 == 0, F.lit(None)).otherwise(F.lit("12"))
    trail = {"class": F.lit("path"), "kind": F.lit("trail")}
    text = F.lit("LINESTRING(0 1, 300 1, 340 40, 1000 40)")
    return _two_lines(spark, sf, F.lit("LINESTRING(0 0, 1000 0)"), text, {"r": {**trail, "name": F.lit("A"), "ref": F.lit("7")}, "a": {**trail, "name": F.lit("B"), "ref": number}}).select("p_partkey", "left100")


@query("c07_signed", "select p_partkey, cast(case when p_partkey % 3 = 0 then 0 else 1 end as int) as kept from part")
def _(spark, sf):
    """A signed route tight for 100 m and then up to 90 m off; of another route, or in bends of twice the length, it is another line."""
    n = c("p_partkey") % 3
    bends = "LINESTRING(0 1, 100 1, " + ", ".join(f"{x} {90 if i % 2 else 1}" for i, x in enumerate(range(120, 1001, 20))) + ")"
    text = F.when(n == 1, bends).otherwise("LINESTRING(0 1, 100 1, 200 90, 900 90, 1000 1)")
    route = {"class": F.lit("path"), "kind": F.lit("trail"), "route_ref": F.lit("JMT")}
    out = _two_lines(spark, sf, F.lit("LINESTRING(0 0, 1000 0)"), text, {"r": {**route, "name": F.lit("A")}, "a": {**route, "name": F.lit("B"), "route_ref": F.when(n == 2, "PNT").otherwise("JMT")}})
    return out.select("p_partkey", (c("left100") > 0).cast("int").alias("kept"))


@query("c08_junctions", "select p_partkey, cast(case when p_partkey % 2 = 0 then 30000 else 28750 end as bigint) as branch100 from part")
def _(spark, sf):
    """A branch that met a survey which the map replaces is led on to the map; one that only came near is not."""
    register(spark)
    none = F.lit(None).cast("string")
    start = F.when(c("p_partkey") % 2 == 0, "12").otherwise("12.5")
    rows = [("r", "OpenStreetMap", True, "Ridge Trail", F.lit("LINESTRING(0 0, 1000 0)")), ("a", "NPS", False, "Ridge Trail", F.lit("LINESTRING(0 12, 500 12, 1000 12)")), ("b", "NPS", False, "Side", F.format_string("LINESTRING(500 %s, 500 300)", start))]
    lines = None
    for ident, agency, reference, name, text in rows:
        one = table(spark, sf, "part").select(
            "p_partkey", F.lit(ident).alias("id"), F.lit(agency).alias("agency"), F.lit(name).alias("name"), F.lit("path").alias("class"), F.lit("trail").alias("kind"), none.alias("route_ref"), none.alias("ref"),
            none.alias("surface"), F.lit(False).alias("bridge"), F.lit(False).alias("tunnel"), F.lit(reference).alias("reference"), g("FromText", text).alias("shape"),
        )
        lines = one if lines is None else lines.unionByName(one)
    out = shapes.conflate(lines, ["p_partkey"], [c("id")]).filter("id = 'b'")
    return out.groupBy("p_partkey").agg(_round(F.sum(g("Length", c("shape"))), 100).alias("branch100"))


@query("x28_planar_metres", "select id, cast(floor(sqrt(pow((u.east - f.lon) * 111320 * cos(radians(f.lat)), 2) + pow((u.north - f.lat) * 111320, 2)) + 1e-6) as bigint) as metres from (select distinct id, lon, lat from facilities where lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)) f, (select max(east) as east, max(north) as north from areas) u where abs(u.east - f.lon) < 180")
def _(spark, sf):
    """Metres from each facility to the far corner of all areas, scaled at the facility's latitude."""
    from ..functions.geo import usable

    east, north = table(spark, sf, "areas").agg(F.max("east"), F.max("north")).first()
    f = table(spark, sf, "facilities").filter(usable(c("lon"), c("lat"))).select("id", "lon", "lat").distinct().filter(F.abs(F.lit(east) - c("lon")) < 180)
    return f.select("id", F.floor(match.flat_m(F.lit(east), F.lit(north), c("lon"), c("lat"), at=c("lat")) + 1e-6).alias("metres"))
