"""Queries of the quadtree operators and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, mercator, names
from ..functions.geo import haversine_m, usable
from ..operators import grid
from ..session import table
from .registry import query

_OK = "(lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0))"
_X = "greatest(0, least(cast(floor(({0} + 180) / 360 * {1}) as bigint), {1} - 1))"
_Y = "greatest(0, least(cast(floor((1 - asinh(tan(radians(greatest(-85.05112878, least(85.05112878, {0}))))) / pi()) / 2 * {1}) as bigint), {1} - 1))"


def _land(spark, sf):
    return table(spark, sf, "landmarks").filter(usable(F.col("lon"), F.col("lat")))


@query("p01_project", f"""select id, cast(round((lon + 180) / 360 * 1e8) as bigint) as wx,
  cast(round((1 - asinh(tan(radians(greatest(-85.05112878, least(85.05112878, lat))))) / pi()) / 2 * 1e8) as bigint) as wy
  from facilities where {_OK}""")
def _(spark, sf):
    f = table(spark, sf, "facilities").filter(usable(F.col("lon"), F.col("lat")))
    scaled = lambda c: F.round(c * 1e8).cast("bigint")
    return f.select("id", scaled(mercator.world_x(F.col("lon"))).alias("wx"), scaled(mercator.world_y(F.col("lat"))).alias("wy"))


@query("p01_inverse", f"""select id, cast(round(lat * 1e4) as bigint) as back from facilities where {_OK} and abs(lat) < 85""")
def _(spark, sf):
    f = table(spark, sf, "facilities").filter(usable(F.col("lon"), F.col("lat"))).filter("abs(lat) < 85")
    return f.select("id", F.round(mercator.inverse_lat(mercator.world_y(F.col("lat"))) * 1e4).cast("bigint").alias("back"))


@query("p02_tile_range", f"""select area_id, {_X.format('west', 1024)} as x0, {_Y.format('north', 1024)} as y0,
  {_X.format('east', 1024)} as x1, {_Y.format('south', 1024)} as y1 from areas""")
def _(spark, sf):
    c = F.col
    return table(spark, sf, "areas").select(
        "area_id", mercator.tile_x(c("west"), 10).alias("x0"), mercator.tile_y(c("north"), 10).alias("y0"),
        mercator.tile_x(c("east"), 10).alias("x1"), mercator.tile_y(c("south"), 10).alias("y1"),
    )


@query("f11_tile_index", f"select id, {_X.format('lon', 16384)} as x, {_Y.format('lat', 16384)} as y from landmarks where {_OK}")
def _(spark, sf):
    return grid.assign(_land(spark, sf), 14).select("id", "x", "y")


_BITS = " + ".join(f"(((x >> {b}) & 1) << {2 * b}) + (((y >> {b}) & 1) << {2 * b + 1})" for b in range(16))


@query("so01_morton", f"""select x, y, {_BITS} as code from (select distinct {_X.format('lon', 4096)} as x, {_Y.format('lat', 4096)} as y
  from landmarks where {_OK})""")
def _(spark, sf):
    t = grid.assign(_land(spark, sf), 12).select("x", "y").distinct()
    return t.select("x", "y", mercator.morton(F.col("x"), F.col("y")).alias("code"))


@query("j29_parent_tiles", f"select x >> 4 as px, y >> 4 as py, count(*) as n from (select {_X.format('lon', 16384)} as x, {_Y.format('lat', 16384)} as y from landmarks where {_OK}) group by all")
def _(spark, sf):
    t = grid.assign(_land(spark, sf), 14)
    return t.groupBy(mercator.parent(F.col("x"), 4).alias("px"), mercator.parent(F.col("y"), 4).alias("py")).agg(F.count("*").alias("n"))


_TILES8 = f"select distinct {_X.format('lon', 256)} as x, {_Y.format('lat', 256)} as y from landmarks where {_OK}"


def _tiles8(spark, sf):
    return grid.assign(_land(spark, sf), 8).select("z", "x", "y").distinct()


@query("set03_halo", f"""with t as ({_TILES8}), d as (select unnest([-1, 0, 1]) as i), n as (select distinct x + a.i as x, y + b.i as y from t, d a, d b)
  select 8 as z, x, y from n where x between 0 and 255 and y between 0 and 255""")
def _(spark, sf):
    return grid.halo(_tiles8(spark, sf))


@query("set07_neighbourhood", f"""with t as ({_TILES8}), d as (select unnest([-1, 0, 1]) as i),
  n as (select distinct 8 as z, (x + a.i + 256) % 256 as x, y + b.i as y from t, d a, d b where y + b.i between 0 and 255),
  c as (select 9 as z, x * 2 + a.i as x, y * 2 + b.i as y from t, d a, d b where a.i >= 0 and b.i >= 0)
  select * from n union all select * from c""")
def _(spark, sf):
    t = _tiles8(spark, sf)
    return grid.halo(t, wrap=True).unionByName(grid.descendants(t, 1))


@query("set04_ancestors", f"""with t as ({_TILES8}), k as (select unnest([1, 2, 3, 4]) as k)
  select distinct 8 - k as z, x >> k as x, y >> k as y from t, k""")
def _(spark, sf):
    return grid.ancestors(_tiles8(spark, sf), 4)


@query("set05_cell_tiles", f"""with t as ({_TILES8}), k as (select unnest([1, 2]) as k), d as (select unnest([0, 1, 2, 3]) as i)
  select distinct 8 - k as z, x >> k as x, y >> k as y from t, k union all
  select 8, x, y from t union all
  select 10, x * 4 + a.i, y * 4 + b.i from t, d a, d b""")
def _(spark, sf):
    t = _tiles8(spark, sf)
    return grid.ancestors(t, 6).unionByName(t).unionByName(grid.descendants(t, 2))


@query("agg19_rectangles", f"""with t as ({_TILES8}), r as (select *, x - row_number() over (partition by y order by x) as run from t)
  select 8 as z, min(x) as x0, y, max(x) as x1 from r group by y, run""")
def _(spark, sf):
    return grid.rectangles(_tiles8(spark, sf))


@query("agg27_object_count", f"with t as ({_TILES8}) select 8 as z, count(*) as objects from t")
def _(spark, sf):
    return grid.rectangles(_tiles8(spark, sf)).groupBy("z").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("objects"))


@query("agg20_tile_count", f"""select area_id, ({_X.format('east', 4096)} - {_X.format('west', 4096)} + 1) * ({_Y.format('south', 4096)} - {_Y.format('north', 4096)} + 1) as n from areas""")
def _(spark, sf):
    c = F.col
    return table(spark, sf, "areas").select("area_id", grid.tile_count(12, c("west"), c("south"), c("east"), c("north")).alias("n"))


_RANGE10 = f"select area_id, {_X.format('west', 1024)} as x0, {_X.format('east', 1024)} as x1, {_Y.format('north', 1024)} as y0, {_Y.format('south', 1024)} as y1 from areas"


@query("l01_enumerate", f"""with r as ({_RANGE10}), k as (select distinct x, y from (select x, unnest(range(y0, y1 + 1)) as y from (select *, unnest(range(x0, x1 + 1)) as x from r)))
  select x, y, code from (select x, y, {_BITS} as code from k) where code > 100000""")
def _(spark, sf):
    return grid.quadtree_keys(table(spark, sf, "areas"), 10, after=100000).select("x", "y", "code")


@query("l02_region_keys", f"""with r as ({_RANGE10}) select area_id, count(*) as n, min(x) as x0, max(y) as y1 from (select *, unnest(range(y0, y1 + 1)) as y from (select *, unnest(range(x0, x1 + 1)) as x from r)) group by 1""")
def _(spark, sf):
    t = grid.cover(table(spark, sf, "areas"), 10)
    return t.groupBy("area_id").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("y").alias("y1"))


@query("set02_region_union", f"""with r as ({_RANGE10}), k as (select kind, x, y from (select *, unnest(range(y0, y1 + 1)) as y from (select *, unnest(range(x0, x1 + 1)) as x from (select kind, r.* from r join areas using (area_id)))))
  select distinct x, y from k where kind in ('park', 'forest', 'wilderness')""")
def _(spark, sf):
    a = table(spark, sf, "areas")
    sets = [grid.cover(a.filter(F.col("kind") == k), 10).select("x", "y") for k in ("park", "forest", "wilderness")]
    return sets[0].union(sets[1]).union(sets[2]).distinct()


@query("j01_range_join", f"""select l.id, a.area_id from landmarks l join areas a on l.lon between a.west and a.east and l.lat between a.south and a.north
  where {_OK} and l.min_zoom <= 13""")
def _(spark, sf):
    p = _land(spark, sf).filter("min_zoom <= 13").select("id", "lon", "lat")
    return grid.covered_pairs(p, table(spark, sf, "areas"), 8, "area_id").select("id", "area_id")


@query("j03_viewport_closed", "select id, min_zoom from landmarks where lon >= -110 and lon <= -100 and lat >= 35 and lat <= 45 and min_zoom <= 13")
def _(spark, sf):
    return table(spark, sf, "landmarks").filter("lon between -110 and -100 and lat between 35 and 45 and min_zoom <= 13").select("id", "min_zoom")


@query("j04_viewport_half_open", "select id from facilities where enabled and lon >= -110 and lon < -100 and lat >= 35 and lat < 45")
def _(spark, sf):
    return table(spark, sf, "facilities").filter("enabled and lon >= -110 and lon < -100 and lat >= 35 and lat < 45").select("id")


@query("p03_valid_tile", f"""with s(tileset, z0, z1, w, s, e, n) as (values ('base', 0, 15, -180.0, -85.0, 180.0, 85.0), ('trails', 6, 14, -125.0, 24.0, -66.0, 50.0), ('dem', 8, 12, -130.0, 20.0, -100.0, 72.0))
  select tileset, count(*) as n from (select distinct tileset, x, y from s, (select lon, lat, {_X.format('lon', 1024)} as x, {_Y.format('lat', 1024)} as y from landmarks where {_OK})
  where 10 between z0 and z1 and lon >= w and lon < e and lat >= s and lat < n) group by 1""")
def _(spark, sf):
    specs = spark.createDataFrame(
        [("base", 0, 15, -180.0, -85.0, 180.0, 85.0), ("trails", 6, 14, -125.0, 24.0, -66.0, 50.0), ("dem", 8, 12, -130.0, 20.0, -100.0, 72.0)],
        "tileset string, z0 int, z1 int, w double, s double, e double, n double",
    )
    t = grid.assign(_land(spark, sf), 10)
    hit = t.join(F.broadcast(specs), (F.col("lon") >= F.col("w")) & (F.col("lon") < F.col("e")) & (F.col("lat") >= F.col("s")) & (F.col("lat") < F.col("n")) & F.col("z").between(F.col("z0"), F.col("z1")))
    return hit.select("tileset", "x", "y").distinct().groupBy("tileset").agg(F.count("*").alias("n"))


@query("p04_coverage", f"""select id, z <= 7 or (lon between -125 and -66 and lat between 24 and 50) as allowed from (select id, lon, lat, (min_zoom - 8) * 2 as z from landmarks where {_OK})""")
def _(spark, sf):
    z = (F.col("min_zoom") - 8) * 2
    return _land(spark, sf).select("id", ((z <= 7) | (F.col("lon").between(-125, -66) & F.col("lat").between(24, 50))).alias("allowed"))


_KEY = "regexp_full_match(k, '(0|[1-9][0-9]*)/(0|[1-9][0-9]*)/(0|[1-9][0-9]*)')"


@query("p06_tile_key", f"""select p_partkey, {_KEY} as ok from (select p_partkey, case p_partkey % 4 when 0 then '0' else '' end || (p_partkey % 15) || '/' || (p_partkey % 500) || case p_partkey % 7 when 0 then '/x' else '/' || (p_partkey % 7) end as k from part)""")
def _(spark, sf):
    k = F.expr("concat(case when p_partkey % 4 = 0 then '0' else '' end, p_partkey % 15, '/', p_partkey % 500, case when p_partkey % 7 = 0 then '/x' else concat('/', p_partkey % 7) end)")
    return table(spark, sf, "part").select("p_partkey", k.rlike(r"^(0|[1-9][0-9]*)/(0|[1-9][0-9]*)/(0|[1-9][0-9]*)\z").alias("ok"))


@query("p18_way_id", "select elem_id, case when (p >> 44) = 2 then p & 17592186044415 else -1 end as way from (select elem_id, elem_id + ((elem_id % 3) << 44) as p from osm_elements)")
def _(spark, sf):
    packed = F.col("elem_id") + F.shiftleft(F.col("elem_id") % 3, 44)
    return table(spark, sf, "osm_elements").select("elem_id", F.coalesce(hashing.packed_way_id(packed), F.lit(-1)).alias("way"))


@query("f09_hashed_id", "select id, cast('0x' || substr(sha256(id), 1, 12) as bigint) as fid from features where id is not null")
def _(spark, sf):
    return table(spark, sf, "features").filter("id is not null").select("id", hashing.hashed_id48(F.col("id")).alias("fid"))


@query("f10_hashed_id", "select id, cast('0x' || substr(sha256(id), 1, 14) as bigint) & 9007199254740991 as fid from features where id is not null")
def _(spark, sf):
    return table(spark, sf, "features").filter("id is not null").select("id", hashing.hashed_id53(F.col("id")).alias("fid"))


_PAIR = f"select a.id as id_a, b.id as id_b, a.lon as lon1, a.lat as lat1, b.lon as lon2, b.lat as lat2 from (select * from (select *, row_number() over (partition by match_group order by id, lon, lat) as rn from (select distinct id, lon, lat, match_group from features where {_OK} and match_group is not null)) where rn = 1) a join (select distinct id, lon, lat, match_group from features where {_OK} and match_group is not null) b using (match_group) where a.id < b.id"


def _pairs(spark, sf):
    """Each record of a group with the group's lead, the one of the least id: as many pairs as records."""
    f = table(spark, sf, "features").filter(usable(F.col("lon"), F.col("lat")) & F.col("match_group").isNotNull()).select("id", "lon", "lat", "match_group").distinct()
    lead = f.groupBy("match_group").agg(F.min(F.struct("id", "lon", "lat")).alias("l"))
    a = lead.select(F.col("l.id").alias("id_a"), F.col("l.lon").alias("lon1"), F.col("l.lat").alias("lat1"), "match_group")
    b = f.select(F.col("id").alias("id_b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "match_group")
    return a.join(b, "match_group").filter("id_a < id_b")


def planar_m(lon1, lat1, lon2, lat2, at):
    """Flat metres with the scale of one latitude; longitudes go round the date line."""
    dx = (F.pmod(lon1 - lon2 + 180, F.lit(360.0)) - 180) * 111320 * F.cos(F.radians(at))
    return F.sqrt(dx * dx + F.pow((lat1 - lat2) * 111320, 2))


@query("f05_distance_mean", f"""with p as ({_PAIR}) select id_a, id_b, cast(floor(sqrt(pow(((lon1 - lon2 + 540) % 360 - 180) * 111320 * cos(radians((lat1 + lat2) / 2)), 2) + pow((lat1 - lat2) * 111320, 2))) as bigint) as m from p""")
def _(spark, sf):
    c = F.col
    m = planar_m(c("lon1"), c("lat1"), c("lon2"), c("lat2"), (c("lat1") + c("lat2")) / 2)
    return _pairs(spark, sf).select("id_a", "id_b", F.floor(m).alias("m"))


@query("f06_distance_first", f"""with p as ({_PAIR}) select id_a, id_b, cast(floor(sqrt(pow(((lon1 - lon2 + 540) % 360 - 180) * 111320 * cos(radians(lat1)), 2) + pow((lat1 - lat2) * 111320, 2))) as bigint) as m from p""")
def _(spark, sf):
    c = F.col
    return _pairs(spark, sf).select("id_a", "id_b", F.floor(planar_m(c("lon1"), c("lat1"), c("lon2"), c("lat2"), c("lat1"))).alias("m"))


@query("f07_haversine", f"""with p as ({_PAIR}) select id_a, id_b, cast(floor(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))) as bigint) as m from p""")
def _(spark, sf):
    c = F.col
    return _pairs(spark, sf).select("id_a", "id_b", F.floor(haversine_m(c("lon1"), c("lat1"), c("lon2"), c("lat2"))).alias("m"))


@query("f08_chord_km", f"""with p as ({_PAIR}), u as (select id_a, id_b, cos(radians(lat1)) * cos(radians(lon1)) - cos(radians(lat2)) * cos(radians(lon2)) as dx,
  cos(radians(lat1)) * sin(radians(lon1)) - cos(radians(lat2)) * sin(radians(lon2)) as dy, sin(radians(lat1)) - sin(radians(lat2)) as dz from p)
  select id_a, id_b, cast(floor(12742000 * asin(least(1, sqrt(dx * dx + dy * dy + dz * dz) / 2))) as bigint) as m from u""")
def _(spark, sf):
    r = lambda c: F.radians(F.col(c))
    xyz = lambda lon, lat: (F.cos(r(lat)) * F.cos(r(lon)), F.cos(r(lat)) * F.sin(r(lon)), F.sin(r(lat)))
    chord = F.sqrt(sum(((p - q) * (p - q) for p, q in zip(xyz("lon1", "lat1"), xyz("lon2", "lat2"))), F.lit(0.0)))
    return _pairs(spark, sf).select("id_a", "id_b", F.floor(12742000 * F.asin(F.least(F.lit(1.0), chord / 2))).alias("m"))


_FOLD = "replace(lower(strip_accents(replace({0}, 'ß', 'ss'))), '', '')"


@query("f01_name_key", f"""with t as (select distinct name, kind, regexp_replace(regexp_replace(trim(regexp_replace({_FOLD.format("coalesce(name, '')")}, '[^a-z0-9]+', ' ', 'g')), '\\bmt\\b', 'mount', 'g'), '\\bcamp ground\\b', 'campground', 'g') as k from features)
  select name, kind, replace(case kind when 'campground' then regexp_replace(k, '\\s+(?:campground|camp\\s+ground)$', '') when 'trailhead' then regexp_replace(k, '\\s+trail\\s*head$', '')
  when 'visitor_center' then regexp_replace(k, '\\s+visitor\\s+cent(?:er|re)$', '') else k end, ' ', '') as name_key from t""")
def _(spark, sf):
    return table(spark, sf, "features").select("name", "kind").distinct().withColumn("name_key", names.name_key(F.col("name"), F.col("kind")))


@query("f04_plain_name", f"select distinct name, regexp_replace({_FOLD.format("coalesce(name, '')")}, '[^a-z0-9]', '', 'g') as k from facilities")
def _(spark, sf):
    return table(spark, sf, "facilities").select("name").distinct().withColumn("k", names.plain_name(F.col("name")))


@query("c01_trail_name", """with t as (select distinct name, regexp_replace(lower(strip_accents(coalesce(name, ''))), '[^\\x00-\\x7F]', '', 'g') as k from landmarks)
  select name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(k, '\\bmt\\b', 'mount', 'g'), '\\bmtn\\b', 'mountain', 'g'), '\\bblvd\\b', 'boulevard', 'g'),
  '\\bsp\\b', 'spur', 'g'), '\\bhwy\\b', 'highway', 'g'), '\\b(trail|trl|road|rd)\\b', '', 'g'), '[^a-z0-9]', '', 'g') as k from t""")
def _(spark, sf):
    return table(spark, sf, "landmarks").select("name").distinct().withColumn("k", names.trail_name(F.col("name")))


@query("f02_clean", """select doc_id, left(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')), 180) as c from documents where text is not null""")
def _(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", names.clean_text(F.col("text"), 180).alias("c"))


@query("f03_display_name")
def _(spark, sf):
    return table(spark, sf, "facilities").select("id", names.display_name(F.col("name")).alias("shown"))


@query("f13_active", "select osm_id, coalesce(lower(trim(tags['drinking_water'])) not in ('', 'no', 'false', '0', 'none'), false) as active from osm_elements")
def _(spark, sf):
    return table(spark, sf, "osm_elements").select("osm_id", names.active_flag(F.col("tags")["drinking_water"]).alias("active"))


@query("c03_road_refs", """select l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct([r for r in [regexp_replace(trim(v), '^(?:NFSR|NF|FR|FS)\\s*[- ]?\\s*([0-9])', '\\1') for v in string_split(upper('fs ' || l_partkey || ';NF-' || l_suppkey || ';Old Road'), ';')] if regexp_matches(r, '[0-9]')])), ',') as refs from lineitem""")
def _(spark, sf):
    ref = F.concat(F.lit("fs "), "l_partkey", F.lit(";NF-"), "l_suppkey", F.lit(";Old Road"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(names.road_refs(ref), ",").alias("refs"))


@query("p13_route_ref", """with t as (select p_partkey, upper(case p_partkey % 6 when 0 then 'Pacific Crest Trail' when 1 then 'pct section ' || p_partkey when 2 then 'Appalachian Trail Spur' when 3 then 'Upper Ice Age Trail' when 4 then 'PCTX path' else p_name end) as u from part)
  select p_partkey, case when regexp_matches(u, '\\b(SPUR|CONNECTOR|ACCESS|APPROACH)\\b') then '' when contains(u, 'PACIFIC CREST') or regexp_matches(u, '^PCT(\\s|$)') then 'PCT' when contains(u, 'APPALACHIAN') then 'AT' when contains(u, 'ICE AGE') then 'IAT' else '' end as route from t""")
def _(spark, sf):
    n = F.expr("case p_partkey % 6 when 0 then 'Pacific Crest Trail' when 1 then concat('pct section ', p_partkey) when 2 then 'Appalachian Trail Spur' when 3 then 'Upper Ice Age Trail' when 4 then 'PCTX path' else p_name end")
    return table(spark, sf, "part").select("p_partkey", names.route_ref(n).alias("route"))
