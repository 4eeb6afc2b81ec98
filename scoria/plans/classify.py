"""Queries of the classification operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import clean_text
from ..operators import classify as c
from ..operators.rejects import split_rejects, typed_gnis
from ..session import table
from .problems import _LINES
from .registry import query


def _case(key: str, table: dict, other: str = "null") -> str:
    quote = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return f"case {key} " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in table.items()) + f" else {other} end"


_KIND = "coalesce(tags['natural'], tags['tourism'], tags['amenity'], tags['highway'], '')"


def _osm(spark, sf):
    t = F.col("tags")
    kind = F.coalesce(t["natural"], t["tourism"], t["amenity"], t["highway"], F.lit(""))
    return table(spark, sf, "osm_elements").select("osm_id", "elem_type", "elem_id", "tags", kind.alias("kind"))


_ROADS = "['motorway', 'primary', 'tertiary', 'residential', 'track', 'city', 'hamlet']"


@query("p05_minimum_zoom", f"""with t as (select l_orderkey, l_linenumber, ['road', 'label', 'building', 'land', 'grass', 'poi'][1 + l_partkey % 6] as kind, {_ROADS}[1 + l_suppkey % 7] as sub from lineitem)
  select l_orderkey, l_linenumber, case kind when 'label' then {_case('sub', c.LABEL_ZOOM, '13')} when 'road' then {_case('sub', {k: int(v) for k, v in c.ROAD_ZOOM.items()}, '14')} else {_case('kind', c.LAYER_ZOOM, '12')} end as z from t""")
def _(spark, sf):
    kind = F.expr("element_at(array('road', 'label', 'building', 'land', 'grass', 'poi'), cast(1 + l_partkey % 6 as int))")
    sub = F.expr("element_at(array('motorway', 'primary', 'tertiary', 'residential', 'track', 'city', 'hamlet'), cast(1 + l_suppkey % 7 as int))")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c.minimum_zoom(kind, sub).alias("z"))


@query("p08_poi_icon", f"""with t as (select osm_id, {_KIND} as k from osm_elements)
  select distinct osm_id, {_case('k', {**c.SQUARE, **c.CIRCLE})} as icon, case when k in ({', '.join(repr(x) for x in c.SQUARE)}) then 'square' else 'circle' end as frame from t
  where k in ({', '.join(repr(x) for x in (*c.SQUARE, *c.CIRCLE))})""")
def _(spark, sf):
    o = _osm(spark, sf).withColumn("p", c.poi_icon(F.col("kind"), F.lit(None).cast("string"))).filter("p is not null")
    return o.select("osm_id", "p.icon", "p.frame").distinct()


@query("p07_base_class", f"""with t as (select distinct elem_id, ['pois', 'roads', 'landuse', 'places', 'water'][1 + elem_id % 5] as layer, {_KIND} as k, case elem_type when 'node' then 'point' when 'way' then 'polygon' else 'line' end as g from osm_elements)
  select elem_id, case when layer = 'pois' and g = 'point' then 'poi' when layer = 'places' and g = 'point' then 'label' when layer = 'water' and g = 'polygon' then 'water' when layer = 'water' and g = 'line' then 'waterline' end as layer, case when layer = 'water' and g = 'line' then 'river' else k end as class from t
  where (layer = 'pois' and g = 'point' and k in ({', '.join(repr(x) for x in (*c.SQUARE, *c.CIRCLE))})) or (layer = 'places' and g = 'point') or (layer = 'water' and g in ('polygon', 'line'))""")
def _(spark, sf):
    layer = F.expr("element_at(array('pois', 'roads', 'landuse', 'places', 'water'), cast(1 + elem_id % 5 as int))")
    shape = F.when(F.col("elem_type") == "node", "point").when(F.col("elem_type") == "way", "polygon").otherwise("line")
    b = c.base_class(layer, F.col("kind"), F.lit(None).cast("string"), shape)
    return _osm(spark, sf).withColumn("b", b).filter("b is not null").select("elem_id", "b.layer", "b.class").distinct()


_NET = "['US:I', 'US:US', 'US:CA', 'US:CA:Yolo', 'US:county', 'CA:ON', ''][1 + l_partkey % 7]"


@query("p09_road_shield", f"""with t as (select l_orderkey, l_linenumber, {_NET} as n, case l_suppkey % 3 when 0 then '' when 1 then ' ' || l_suppkey || ' ' else 'Long text ' || l_suppkey end as x, l_linenumber || ';' || l_suppkey as ref from lineitem),
  u as (select *, coalesce(nullif(trim(x), ''), trim(split_part(ref, ';', 1))) as text from t)
  select l_orderkey, l_linenumber, text, case when n = 'US:I' or n like 'US:I:%' then 'interstate' when n = 'US:US' or n like 'US:US:%' then 'us' when n like 'US:%' and (n like '%county%' or n like '%:%:%') then 'county' when n like 'US:%' then 'state' else 'generic' end as kind from u where length(text) <= 8""")
def _(spark, sf):
    net = F.expr("element_at(array('US:I', 'US:US', 'US:CA', 'US:CA:Yolo', 'US:county', 'CA:ON', ''), cast(1 + l_partkey % 7 as int))")
    text = F.expr("case l_suppkey % 3 when 0 then '' when 1 then concat(' ', l_suppkey, ' ') else concat('Long text ', l_suppkey) end")
    s = c.road_shield(net, text, F.expr("concat(l_linenumber, ';', l_suppkey)"))
    return table(spark, sf, "lineitem").withColumn("s", s).filter("s is not null").select("l_orderkey", "l_linenumber", "s.text", "s.kind")


@query("p10_admission", "select id, name, kind, min_zoom from landmarks where min_zoom <= 12 + 1 and coalesce(name, '') <> ''")
def _(spark, sf):
    z = 12
    return table(spark, sf, "landmarks").filter((F.col("min_zoom") <= z + 1) & (F.coalesce("name", F.lit("")) != "")).select("id", "name", "kind", "min_zoom")


_REC = {"campground": "campsite", "trailhead": "information", "ranger_station": "information", "visitor_center": "information", "picnic_site": "picnic-site", "shelter": "marker", "viewpoint": "viewpoint"}


@query("p11_recreation", f"""select id, trim(regexp_replace(coalesce(name, ''), '\\s+', ' ', 'g')) as name, kind, {_case('kind', _REC)} as icon, case when unit in ('', 'No Data', 'Unknown') then null else trim(unit) end as unit
  from facilities where enabled and lon between -180 and 180 and (lon <= -60 or lon >= 170) and lat between 18 and 72 and kind in ({', '.join(repr(k) for k in _REC)})""")
def _(spark, sf):
    f = table(spark, sf, "facilities").filter(F.col("enabled") & c.in_envelope(F.col("lon"), F.col("lat")))
    icon = c.lookup(F.col("kind"), _REC)
    unit = F.when(~F.col("unit").isin("", "No Data", "Unknown"), F.trim("unit"))
    return f.filter(icon.isNotNull()).select("id", clean_text(F.col("name"), 180).alias("name"), "kind", icon.alias("icon"), unit.alias("unit"))


@query("p12_trail_fields", """select l_orderkey, l_linenumber, coalesce(nullif(a, ''), nullif(b, ''), '') as name, case when l_linenumber % 3 = 0 then 'NPS' else 'USFS' end as agency, l_linestatus as use from
  (select *, case l_partkey % 3 when 0 then '' when 1 then 'Trail ' || l_partkey end as a, case l_partkey % 2 when 0 then 'Alt ' || l_partkey else '' end as b from lineitem) where not (l_linenumber % 3 = 0 and lower(l_returnflag) in ('n', 'no', 'false'))""")
def _(spark, sf):
    a = F.expr("case l_partkey % 3 when 0 then '' when 1 then concat('Trail ', l_partkey) end")
    b = F.expr("case l_partkey % 2 when 0 then concat('Alt ', l_partkey) else '' end")
    some = lambda x: F.nullif(x, F.lit(""))
    nps = F.col("l_linenumber") % 3 == 0
    t = table(spark, sf, "lineitem").filter(~(nps & F.lower("l_returnflag").isin("n", "no", "false")))
    return t.select("l_orderkey", "l_linenumber", F.coalesce(some(a), some(b), F.lit("")).alias("name"), F.when(nps, "NPS").otherwise("USFS").alias("agency"), F.col("l_linestatus").alias("use"))


_SURFACE = "['asphalt', ' Paved ', 'AC - ASPHALT', 'NAT - NATIVE', 'BST - CHIP', '', 'gravel'][1 + l_partkey % 7]"


@query("p15_road_class", f"""select l_orderkey, l_linenumber, case when s in ('ASPHALT', 'PAVED', 'CONCRETE') or s like 'AC -%' or s like 'BST -%' or s like 'PCC -%' then 'unclassified' else 'track' end as class from (select *, upper(trim({_SURFACE})) as s from lineitem)""")
def _(spark, sf):
    s = F.expr("element_at(array('asphalt', ' Paved ', 'AC - ASPHALT', 'NAT - NATIVE', 'BST - CHIP', '', 'gravel'), cast(1 + l_partkey % 7 as int))")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(c.paved(s), "unclassified").otherwise("track").alias("class"))


_FLOW = "['yes', 'no', '', 'spring', null, 'False'][1 + {0} % 6]"


@query("p17_flow", f"""with t as (select l_orderkey, l_linenumber, {_FLOW.format('l_partkey')} as i, {_FLOW.format('l_suppkey')} as s from lineitem)
  select l_orderkey, l_linenumber, case when coalesce(lower(trim(s)) not in ('', 'no', 'false', '0', 'none'), false) then 'seasonal' when coalesce(lower(trim(i)) not in ('', 'no', 'false', '0', 'none'), false) then 'intermittent'
  when coalesce(i in ('no', 'false', '0'), false) or coalesce(s in ('no', 'false', '0'), false) then 'perennial' else 'unknown' end as flow from t""")
def _(spark, sf):
    v = lambda k: F.expr(f"element_at(array('yes', 'no', '', 'spring', null, 'False'), cast(1 + {k} % 6 as int))")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c.flow(v("l_partkey"), v("l_suppkey")).alias("flow"))


@query("p19_gazetteer_points", f"""{_LINES}, g as (select line_id, f[2] as name, f[3] as class, cast(lat as double) as lat, cast(lon as double) as lon from r where reason is null)
  select line_id, name, {_case('class', c.GNIS_KIND)} as kind, {_case('class', c.GNIS_ZOOM)} as min_zoom from g where class in ({', '.join(repr(k) for k in c.GNIS_KIND)}) and name <> '' and not contains(lower(name), '(historical)')
  and lon between -180 and 180 and (lon <= -60 or lon >= 170) and lat between 18 and 72""")
def _(spark, sf):
    good, _ = split_rejects(table(spark, sf, "gnis_lines"))
    f = F.col("fields")
    g = typed_gnis(good).filter(c.in_envelope(F.col("lon"), F.col("lat")))
    kind = c.lookup(f["feature_class"], c.GNIS_KIND)
    g = g.filter(kind.isNotNull() & (f["feature_name"] != "") & ~F.lower(f["feature_name"]).contains("(historical)"))
    return g.select("line_id", f["feature_name"].alias("name"), kind.alias("kind"), c.lookup(f["feature_class"], c.GNIS_ZOOM).alias("min_zoom"))


@query("p20_amenity_icons", f"""with t as (select distinct osm_id, [{_case("tags['amenity']", c.AMENITY)}, {_case("tags['tourism']", c.TOURISM)}, case when tags['drinking_water'] = 'yes' then 'drinking-water' end] as f from osm_elements)
  select osm_id, array_to_string([x for x in {c.ICON_ORDER} if list_contains(f, x)], ',') as icons from t""")
def _(spark, sf):
    return table(spark, sf, "osm_elements").select("osm_id", F.array_join(c.amenity_icons(F.col("tags")), ",").alias("icons")).distinct()


@query("p21_osm_kind", f"""with t as (select distinct osm_id, coalesce({_case("tags['tourism']", c.TOURISM)}, {_case("tags['amenity']", c.AMENITY)}, 'mountain') as i, regexp_replace(lower(strip_accents(coalesce(tags['name'], ''))), '[^a-z0-9]', '', 'g') as k from osm_elements)
  select osm_id, case i when 'information' then case when contains(k, 'trailhead') then 'trailhead' when regexp_matches(k, 'visitorcent(er|re)') then 'visitor_center' when contains(k, 'ranger') then 'ranger_station' else 'information' end
  when 'campsite' then 'campground' when 'toilet' then 'restroom' when 'drinking-water' then 'drinking_water' when 'shop' then 'store' when 'restaurant' then 'food' when 'picnic-site' then 'picnic_site' when 'mountain' then 'summit' else i end as kind from t""")
def _(spark, sf):
    t = F.col("tags")
    icon = F.coalesce(c.lookup(t["tourism"], c.TOURISM), c.lookup(t["amenity"], c.AMENITY), F.lit("mountain"))
    return table(spark, sf, "osm_elements").select("osm_id", c.osm_kind(icon, t["name"]).alias("kind")).distinct()


@query("p22_land_cover", f"select class, count(*) as n from (select {_case('(l_partkey * 7 + l_suppkey) % 97', c.LAND_COVER)} as class from lineitem) where class is not null group by 1")
def _(spark, sf):
    code = ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 97).cast("int")
    return table(spark, sf, "lineitem").select(c.lookup(code, c.LAND_COVER).alias("class")).filter("class is not null").groupBy("class").agg(F.count("*").alias("n"))


@query("p23_area_zoom", """with t as (select *, greatest(0, east - west) * greatest(0, north - south) as span, kind = 'park' and contains(lower(coalesce(designation, '') || ' ' || name), 'national park') as nat from areas)
  select area_id, case when nat or span > 8 then 3 when kind = 'forest' then 5 when kind = 'wilderness' then 7 else 6 end as min_zoom, cast(floor((case when nat then 0 when kind = 'forest' then 1 when kind = 'wilderness' then 2 else 3 end - least(span, 100) / 1000) * 1e6) as bigint) as priority from t""")
def _(spark, sf):
    a = table(spark, sf, "areas")
    z = c.area_zoom(*(F.col(x) for x in ("kind", "name", "designation", "west", "south", "east", "north")))
    return a.select("area_id", z["min_zoom"].alias("min_zoom"), F.floor(z["priority"] * 1e6).alias("priority"))


@query("p24_icon_grid", f"""with t as (select distinct osm_id, [x for x in {c.ICON_ORDER} if list_contains([{_case("tags['amenity']", c.AMENITY)}, {_case("tags['tourism']", c.TOURISM)}, case when tags['drinking_water'] = 'yes' then 'drinking-water' end], x)] as i from osm_elements)
  select osm_id, array_to_string(i[1:12], '+') as grid_image, cast(ceil(len(i) / 3) as int) as grid_rows from t where len(i) > 0""")
def _(spark, sf):
    i = c.amenity_icons(F.col("tags"))
    t = table(spark, sf, "osm_elements").select("osm_id", i.alias("i")).filter("size(i) > 0")
    return t.select("osm_id", F.array_join(F.slice("i", 1, 12), "+").alias("grid_image"), F.ceil(F.size("i") / 3).cast("int").alias("grid_rows")).distinct()


@query("p25_visibility", "select osm_id, case when k in ('peak', 'saddle') then 13 <= 14 when k in ('camp_site', 'picnic_site') then true else 14 >= 15 end as visible from (select distinct osm_id, coalesce(tags['natural'], tags['tourism'], tags['amenity'], '') as k from osm_elements)")
def _(spark, sf):
    t, zoom = F.col("tags"), 14
    k = F.coalesce(t["natural"], t["tourism"], t["amenity"], F.lit(""))
    first = F.when(k.isin("peak", "saddle"), 13).when(k.isin("camp_site", "picnic_site"), 12).otherwise(15)
    return table(spark, sf, "osm_elements").select("osm_id", (first <= zoom).alias("visible")).distinct()


@query("p26_distinctive", f"""select distinct id, coalesce(agency <> '', false) and coalesce(unit <> '', false) and len([w for w in string_split_regex(lower(strip_accents(coalesce(name, ''))), '[^a-z0-9]+') if length(w) >= 3 and not list_contains({c.FACILITY_WORDS}, w)]) > 0 as d from features""")
def _(spark, sf):
    return table(spark, sf, "features").select("id", c.distinctive(F.col("name"), F.col("agency"), F.col("unit")).alias("d")).distinct()


_STYLE = ["case", ["==", ["get", "natural"], "peak"], ["interpolate", ["linear"], ["zoom"], 10, 1, 14, 5], ["match", ["get", "tourism"], ["camp_site", "picnic_site"], ["step", ["zoom"], 2, 11, 3, 13, 4], 0]]


@query("p27_style", "select distinct osm_id, cast(case when tags['natural'] = 'peak' then 3.0 when tags['tourism'] in ('camp_site', 'picnic_site') then 3 else 0 end as double) as size from osm_elements")
def _(spark, sf):
    return table(spark, sf, "osm_elements").select("osm_id", c.style(_STYLE, F.col("tags"), 12.0).cast("double").alias("size")).distinct()


@query("p30_roles", "select distinct c_custkey, case when c_custkey % 7 = 0 then 'client' when c_custkey % 11 = 0 then 'warm' end as role from customer where c_custkey % 7 = 0 or c_custkey % 11 = 0")
def _(spark, sf):
    digest = lambda c_: F.sha2(c_.cast("string"), 256)
    cust = table(spark, sf, "customer").select("c_custkey")
    held = cust.filter("c_custkey % 7 = 0 or c_custkey % 11 = 0").select(digest(F.col("c_custkey")).alias("digest"), F.when(F.col("c_custkey") % 7 == 0, "client").otherwise("warm").alias("role"))
    return cust.withColumn("digest", digest(F.col("c_custkey"))).join(held, "digest").select("c_custkey", "role").distinct()


@query("p32_main_route", """select p_partkey, r <> '' and not regexp_matches(n, '(?i)\\b(alternate|spur|bypass|connector|access|approach|detour)\\b') as main from (select p_partkey, case when p_partkey % 2 = 0 then 'PCT' else '' end as r, case p_partkey % 5 when 0 then 'Main Alternate' when 1 then 'Spurious way' when 2 then 'Old SPUR' else p_name end as n from part)""")
def _(spark, sf):
    n = F.expr("case p_partkey % 5 when 0 then 'Main Alternate' when 1 then 'Spurious way' when 2 then 'Old SPUR' else p_name end")
    r = F.expr("case when p_partkey % 2 = 0 then 'PCT' else '' end")
    return table(spark, sf, "part").select("p_partkey", c.main_route(r, F.lit("trail"), n).alias("main"))


@query("p31_gps_valid", "select event_id, abs(value) <= 90 and value > 0 as ok from events")
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", (F.coalesce(F.abs(v) <= 90, F.lit(False)) & (v > 0)).alias("ok"))
