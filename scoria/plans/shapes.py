"""Queries of the geometry operators; with SQL where shapes are boxes and level lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import box, g, line, register
from ..operators import shapes
from ..operators.grid import cover
from ..session import table
from .registry import query

_SEG = "select l_orderkey * 100 + l_linenumber as id, l_linenumber % 3 as a, (l_partkey % 500) * 10 as x0, (l_partkey % 500) * 10 + 50 + cast(l_quantity as bigint) * 5 as x1, (l_orderkey % 200) * 100 + (l_linenumber * 7) % 20 as y, l_partkey from lineitem"


def _seg(spark, sf):
    register(spark)
    x0 = (F.col("l_partkey") % 500) * 10
    t = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") % 3).alias("a"), x0.alias("x0"),
        (x0 + 50 + F.col("l_quantity").cast("bigint") * 5).alias("x1"), ((F.col("l_orderkey") % 200) * 100 + (F.col("l_linenumber") * 7) % 20).alias("y"), "l_partkey",
    )
    point = lambda x: F.struct(x.alias("x"), F.col("y").alias("y"))
    return t.withColumn("shape", line(F.array(point(F.col("x0")), point(F.col("x1")))))


def _areas(spark, sf):
    register(spark)
    c = F.col
    return table(spark, sf, "areas").withColumn("shape", box(c("west"), c("south"), c("east"), c("north")))


def _round(c, n):
    return F.round(c * n).cast("bigint")


@query("g01_clip_lines", f"with s as ({_SEG}) select id, greatest(0, least(x1, 3000) - greatest(x0, 2000)) as kept from s where least(x1, 3000) > greatest(x0, 2000) and y between 5000 and 6000")
def _(spark, sf):
    w = box(F.lit(2010.0), F.lit(5010.0), F.lit(2990.0), F.lit(5990.0))
    s = _seg(spark, sf).filter("y between 5000 and 6000").withColumn("k", g("Clip", F.col("shape"), w, 10.0, 0.0, "line")).filter("k is not null")
    return s.select("id", _round(g("Length", F.col("k")), 1).alias("kept"))


@query("g02_clip_areas", "select area_id, cast(round((least(east, cx + 1) - greatest(west, cx)) * (least(north, cy + 1) - greatest(south, cy)) * 1e6) as bigint) as a from (select area_id, west, south, east, north, cx, unnest(range(cast(floor(south) as bigint), cast(floor(north) as bigint) + 1)) as cy from (select *, unnest(range(cast(floor(west) as bigint), cast(floor(east) as bigint) + 1)) as cx from areas)) where least(east, cx + 1) > greatest(west, cx) and least(north, cy + 1) > greatest(south, cy)")
def _(spark, sf):
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo), F.floor(hi)))
    a = _areas(spark, sf).withColumn("cx", span("west", "east")).withColumn("cy", span("south", "north"))
    k = g("Clip", F.col("shape"), box(F.col("cx"), F.col("cy"), F.col("cx") + 1, F.col("cy") + 1), 0.0, 0.0, "polygon")
    return a.withColumn("k", k).filter("k is not null").select("area_id", _round(g("Area", F.col("k")), 1e6).alias("a"))


@query("g03_overzoom", "select area_id, cast(round((east - west) * (north - south) * 16 * 1e4) as bigint) as a from areas")
def _(spark, sf):
    m = F.array(*(F.lit(x) for x in (4.0, 0.0, 7.0, 0.0, 4.0, -3.0)))
    return _areas(spark, sf).select("area_id", _round(g("Area", g("Affine", F.col("shape"), m)), 1e4).alias("a"))


@query("g04_flatten", f"with s as ({_SEG}) select l_partkey % 500 as k, count(*) as n from s group by 1")
def _(spark, sf):
    s = _seg(spark, sf).withColumn("part", F.explode(g("Lines", F.col("shape"))))
    return s.groupBy((F.col("l_partkey") % 500).alias("k")).agg(F.count("*").alias("n"))


@query("g05_repair", "select area_id, cast(round((east - west) * (north - south) / 2 * 1e6) as bigint) as a from areas")
def _(spark, sf):
    n = lambda c: F.col(c).cast("string")
    bow = F.format_string("POLYGON((%1$s %2$s, %3$s %4$s, %3$s %2$s, %1$s %4$s, %1$s %2$s))", n("west"), n("south"), n("east"), n("north"))
    return _areas(spark, sf).select("area_id", _round(g("Area", g("RepairArea", g("FromText", bow))), 1e6).alias("a"))


@query("g06_label_center", "select area_id, cast(round((west + east) / 2 * 1e6) as bigint) as x, cast(round((south + north) / 2 * 1e6) as bigint) as y from areas")
def _(spark, sf):
    at = F.split(F.regexp_extract(g("AsText", g("LabelCenter", F.col("shape"))), r"\((.*)\)", 1), " ")
    return _areas(spark, sf).withColumn("at", at).select("area_id", _round(F.col("at")[0].cast("double"), 1e6).alias("x"), _round(F.col("at")[1].cast("double"), 1e6).alias("y"))


@query("g07_lake_axis", "select area_id, greatest(east - west, north - south) / least(east - west, north - south) >= 1.4 as elongated, cast(round(greatest(east - west, north - south) * 1e5) as bigint) as length from areas")
def _(spark, sf):
    a = _areas(spark, sf).withColumn("x", g("Axis", F.col("shape")))
    return a.select("area_id", (F.col("x.length") / F.col("x.width") >= 1.4).alias("elongated"), _round(F.col("x.length"), 1e5).alias("length"))


@query("g10_coast_water", "select area_id, cast(round((east - west) / 2 * (north - south) * 1e6) as bigint) as water from areas")
def _(spark, sf):
    a = _areas(spark, sf)
    mid = (F.col("west") + F.col("east")) / 2
    p = lambda y: F.struct(mid.alias("x"), y.alias("y"))
    coast = line(F.array(p(F.col("south") - 1), p(F.col("north") + 1)))  # northward: water in the east half
    return a.select("area_id", _round(g("Area", g("CoastWater", F.array(coast), F.col("shape"))), 1e6).alias("water"))


@query("g11_relation", "select area_id, cast(round((east - west) * (north - south) * 0.75 * 1e6) as bigint) as a from areas")
def _(spark, sf):
    c = F.col
    w, h = c("east") - c("west"), c("north") - c("south")
    hole = g("Boundary", box(c("west") + w / 4, c("south") + h / 4, c("east") - w / 4, c("north") - h / 4))
    return _areas(spark, sf).select("area_id", _round(g("Area", g("Relation", F.array(g("Boundary", c("shape"))), F.array(hole))), 1e6).alias("a"))


@query("g12_minus_water", "select a.area_id as id_a, b.area_id as id_b, cast(round(((a.east - a.west) * (a.north - a.south) - (least(a.east, b.east) - greatest(a.west, b.west)) * (least(a.north, b.north) - greatest(a.south, b.south))) * 1e6) as bigint) as left6 from areas a join areas b on a.area_id <> b.area_id and a.kind = b.kind and a.west < b.east and b.west < a.east and a.south < b.north and b.south < a.north")
def _(spark, sf):
    side = lambda s: cover(_areas(spark, sf), 8).select("x", "y", *(F.col(c).alias(f"{c}_{s}") for c in ("area_id", "kind", "shape", "west", "east", "south", "north")))
    j = side("a").join(side("b"), ["x", "y"]).filter("area_id_a <> area_id_b and kind_a = kind_b and west_a < east_b and west_b < east_a and south_a < north_b and south_b < north_a")
    j = j.dropDuplicates(["area_id_a", "area_id_b"])
    return j.select(F.col("area_id_a").alias("id_a"), F.col("area_id_b").alias("id_b"), _round(g("Area", g("Difference", F.col("shape_a"), F.col("shape_b"))), 1e6).alias("left6"))


@query("g13_wrap", "select area_id, cast(round((east - west) * (north - south) * 1e5) as bigint) as a from areas")
def _(spark, sf):
    c = F.col
    a = _areas(spark, sf).withColumn("over", box(c("west") + 270, c("south"), c("east") + 270, c("north")))
    return a.select("area_id", _round(g("Area", g("Wrap", c("over"))), 1e5).alias("a"))


@query("g14_directory", "select area_id, cast(round((round(east, 2) - round(west, 2)) * (round(north, 2) - round(south, 2)) * 1e4) as bigint) as a from areas where round(east, 2) > round(west, 2) and round(north, 2) > round(south, 2) and least(abs(west * 100 - floor(west * 100) - 0.5), abs(east * 100 - floor(east * 100) - 0.5), abs(south * 100 - floor(south * 100) - 0.5), abs(north * 100 - floor(north * 100) - 0.5)) > 1e-6")
def _(spark, sf):
    half = lambda c: F.abs(F.col(c) * 100 - F.floor(F.col(c) * 100) - 0.5)
    a = _areas(spark, sf).filter(F.least(*(half(c) for c in ("west", "east", "south", "north"))) > 1e-6)
    a = a.select("area_id", _round(g("Area", g("Rounded", F.col("shape"), 0.0, 2)), 1e4).alias("a"))
    return a.filter("a > 0")


@query("g15_outline", "select area_id, cast(round(2 * (east - west + north - south) * 1e5) as bigint) as l from areas")
def _(spark, sf):
    return _areas(spark, sf).select("area_id", _round(g("Length", g("Boundary", F.col("shape"))), 1e5).alias("l"))


@query("agg01_merge_parts", f"with s as (select distinct y, x0, x1 from ({_SEG})), m as (select *, max(x1) over (partition by y order by x0, x1 rows between unbounded preceding and 1 preceding) as before from s), r as (select *, sum(case when before is null or x0 > before then 1 else 0 end) over (partition by y order by x0, x1 rows unbounded preceding) as run from m) select y, min(x0) as x0, max(x1) - min(x0) as length from r group by y, run")
def _(spark, sf):
    m = shapes.merge_parts(_seg(spark, sf).select("y", "x0", "x1", "shape").distinct(), ["y"])
    x = F.split(F.regexp_extract(g("AsText", F.col("part")), r"\((.*)\)", 1), ",? ")
    xs = F.transform(F.filter(x, lambda v, i: i % 2 == 0), lambda v: v.cast("double"))
    return m.select("y", F.array_min(xs).cast("bigint").alias("x0"), _round(g("Length", F.col("part")), 1).alias("length"))


@query("agg03_dissolve", """with x as (select kind, x, lead(x) over (partition by kind order by x) as x1 from (select distinct kind, unnest([west, east]) as x from areas)),
  y as (select kind, y, lead(y) over (partition by kind order by y) as y1 from (select distinct kind, unnest([south, north]) as y from areas))
  select x.kind, cast(round(sum((x1 - x) * (y1 - y)) * 1e4) as bigint) as area from x join y on x.kind = y.kind
  where x1 is not null and y1 is not null and exists (select 1 from areas a where a.kind = x.kind and a.west <= x and a.east >= x1 and a.south <= y and a.north >= y1) group by 1""")
def _(spark, sf):
    d = shapes.dissolve(_areas(spark, sf).select("kind", "shape"), ["kind"])
    return d.select("kind", _round(g("Area", F.col("shape")), 1e4).alias("area"))


# Lines of a row (80 apart from the next), a name and an agency are one group; runs are its lines put together, at each height and over all.
_RUNS = f"""s as (select a, y, y // 100 as row_no, l_partkey % 8 as name, x0, x1 from ({_SEG})),
  m as (select *, max(x1) over (partition by row_no, name, a, y order by x0, x1 rows between unbounded preceding and 1 preceding) as before from s),
  r as (select *, sum(case when before is null or x0 > before then 1 else 0 end) over (partition by row_no, name, a, y order by x0, x1 rows unbounded preceding) as run from m),
  runs as (select row_no, name, a, y, min(x0) as x0, max(x1) as x1 from r group by row_no, name, a, y, run),
  length as (select row_no, name, a, sum(x1 - x0) as total from runs group by 1, 2, 3)"""


def _covered(widths: str, reach: str) -> str:
    """Covered length of each run's group by another agency's group, within widths d; a covering run reaches `reach` beyond its ends."""
    return f"""hit as (select p.row_no, p.name, p.a as a, q.a as b, d, p.y, p.x0 as p0, greatest(p.x0, q.x0 - {reach}) as x0, least(p.x1, q.x1 + {reach}) as x1
      from runs p join runs q on p.row_no = q.row_no and p.name = q.name and p.a <> q.a cross join (select unnest({widths}) as d) w where abs(p.y - q.y) <= d),
    hm as (select *, max(x1) over (partition by row_no, name, a, b, d, y, p0 order by x0, x1 rows between unbounded preceding and 1 preceding) as before from hit where x1 > x0),
    covered as (select row_no, name, a, b, d, sum(greatest(0, x1 - greatest(x0, coalesce(before, x0)))) as part from hm group by 1, 2, 3, 4, 5)"""


def _rows(spark, sf):
    s = _seg(spark, sf)
    return s.select(F.floor(F.col("y") / 100).alias("row_no"), (F.col("l_partkey") % 8).alias("name"), F.col("a").alias("agency"), "shape")


@query("j25_named_overlap", f"""with {_RUNS}, {_covered('[50]', '0')}
  select u.row_no, u.name, u.a as agency_a, u.b as agency_b, cast(round(least(u.part, v.part)) as bigint) as shared from covered u join covered v on u.row_no = v.row_no and u.name = v.name and u.a = v.b and u.b = v.a
  join length x on x.row_no = u.row_no and x.name = u.name and x.a = u.a join length z on z.row_no = u.row_no and z.name = u.name and z.a = u.b
  where u.a < u.b and least(u.part, v.part) >= 100 and least(u.part, v.part) * 2 >= least(x.total, z.total)""")
def _(spark, sf):
    """Agencies whose lines of one name, row by row, lie within 50 m of each other, ends cut flat, for 100 m and half the shorter."""
    o = shapes.overlaps(_rows(spark, sf), ["row_no", "name"], "agency")
    return o.select("row_no", "name", "agency_a", "agency_b", _round(F.col("shared"), 1).alias("shared"))


@query("j12_site_distance", "select f.id, a.area_id from (select distinct id, lon, lat from facilities where lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)) f join areas a on sqrt(pow(greatest(0, a.west - f.lon, f.lon - a.east), 2) + pow(greatest(0, a.south - f.lat, f.lat - a.north), 2)) <= 0.05")
def _(spark, sf):
    from ..functions.geo import usable
    from ..operators.nearby import containing_regions

    a, c = _areas(spark, sf), F.col
    grown = a.select("area_id", (c("west") - 0.05).alias("west"), (c("south") - 0.05).alias("south"), (c("east") + 0.05).alias("east"), (c("north") + 0.05).alias("north"))
    f = table(spark, sf, "facilities").filter(usable(c("lon"), c("lat"))).select("id", "lon", "lat").distinct()
    j = containing_regions(f, grown).join(a.select("area_id", "shape"), "area_id")
    p = g("FromText", F.format_string("POINT(%s %s)", c("lon").cast("string"), c("lat").cast("string")))
    return j.filter(g("Distance", p, c("shape")) <= 0.05).select("id", "area_id")


_WIDTHS = (15, 30, 50)


@query("agg22_coverage", f"""with {_RUNS}, {_covered('[15, 30, 50]', 'sqrt(d * d - (p.y - q.y) * (p.y - q.y))')},
  pairs as (select x.row_no, x.name, x.a as a, z.a as b, x.total as la, z.total as lb from length x join length z on x.row_no = z.row_no and x.name = z.name and x.a < z.a)
  select row_no, name, p.a as agency_a, p.b as agency_b, """ + ", ".join(
    f"cast(floor(1000 * coalesce((select part from covered c where c.row_no = p.row_no and c.name = p.name and c.d = {d} and c.a = p.{x} and c.b = p.{y}), 0) / l{x} + 0.5) as bigint) as {x}{d}"
    for x, y in ("ab", "ba") for d in _WIDTHS) + " from pairs p")
def _(spark, sf):
    """Share, in thousandths, of the lines of each of two agencies, row and name, that lies within 15, 30 and 50 m of the other's."""
    o = shapes.coverage(_rows(spark, sf), ["row_no", "name"], "agency")
    return o.select("row_no", "name", "agency_a", "agency_b", *(F.floor(1000 * F.col(f"{x}{d}") + 0.5).cast("bigint").alias(f"{x}{d}") for x in "ab" for d in _WIDTHS))


@query("c09_conflate")
def _(spark, sf):
    """Retained length of every line, by cell: reference lines whole, additions without what lies along them."""
    s = _seg(spark, sf).withColumn("cell", F.floor(F.col("y") / 100))
    agency = F.when(F.col("a") == 0, "OpenStreetMap").when(F.col("a") == 1, "NPS").otherwise("USFS")
    none = F.lit(None).cast("string")
    lines = s.select(
        "cell", F.col("id").cast("string").alias("id"), agency.alias("agency"), F.concat(F.lit("Trail "), F.col("l_partkey") % 8).alias("name"), F.lit("path").alias("class"),
        F.lit("trail").alias("kind"), none.alias("route_ref"), none.alias("ref"), none.alias("surface"), F.lit(False).alias("bridge"), F.lit(False).alias("tunnel"),
        (F.col("a") == 0).alias("reference"), "shape",
    )
    out = shapes.conflate(lines, ["cell"], [F.col("agency"), F.col("id")])
    return out.groupBy("cell", "id", "agency").agg(F.round(F.sum(g("Length", F.col("shape"))), 3).alias("length"), F.max(F.size("also")).alias("also"))


@query("b04_outlines")
def _(spark, sf):
    cells = cover(_areas(spark, sf).filter("kind in ('park', 'wilderness', 'forest')"), 6)
    out = shapes.outlines(cells, ["z", "x", "y"], 1 / 111_320)
    return out.select("x", "y", "area_id", F.round(g("Length", F.col("stroke")), 6).alias("stroke"), F.round(g("Area", F.col("shape")), 9).alias("area"))
