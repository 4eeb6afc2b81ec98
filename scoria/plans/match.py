"""Queries of the matching and ranking operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import usable
from ..functions.names import name_key, plain_name
from ..operators import match as m
from ..operators import rank
from ..operators.classify import lookup
from ..operators.nearby import containing_regions
from ..session import table
from .registry import query

_OK = "(lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0))"
_K = "regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(replace(coalesce(name, ''), 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')), '\\bmt\\b', 'mount', 'g'), '\\bcamp ground\\b', 'campground', 'g')"
_KEY = f"replace(case kind when 'campground' then regexp_replace({_K}, '\\s+(?:campground|camp\\s+ground)$', '') when 'trailhead' then regexp_replace({_K}, '\\s+trail\\s*head$', '') when 'visitor_center' then regexp_replace({_K}, '\\s+visitor\\s+cent(?:er|re)$', '') else {_K} end, ' ', '')"
_M = "sqrt(pow(((a.lon - b.lon + 540) % 360 - 180) * 111320 * cos(radians((a.lat + b.lat) / 2)), 2) + pow((a.lat - b.lat) * 111320, 2))"
_GENERIC = str(m.GENERIC)
_FAMILY = "case when kind = 'rock' then 'summit' else kind end"


def _records(t: str, extra: str = "", where: str = "true") -> str:
    return f"select distinct id, name, kind, lon, lat, {_KEY} as key, {_FAMILY} as family{extra} from {t} where {_OK} and {where}"


_LIMIT = "case when a.kind in ('summit', 'rock', 'pass') then 300 when a.kind in ('restroom', 'drinking_water', 'store', 'food') then 15 else 120 end"


def _land(spark, sf, agency):
    l = table(spark, sf, "landmarks").filter(F.col("agency") == agency)  # noqa: E741
    return m.keyed(l.select("id", "name", "kind", "lon", "lat", F.col("feature_id").cast("string").alias("gnis_id"), F.lit(False).alias("match_ambiguous")).distinct())


def _features(spark, sf):
    return m.keyed(table(spark, sf, "features").select("id", "name", "kind", "lon", "lat", "gnis_id", "match_ambiguous").distinct())


@query("j05_entity_match", f"""with a as ({_records('landmarks', ', cast(feature_id as varchar) as gnis_id', "agency = 'USGS GNIS'")}),
  b as ({_records('features', ', gnis_id, match_ambiguous')}),
  p as (select a.id as id_a, b.id as id_b, {_M} as m, 'gnis_id' as reason from a join b on a.gnis_id = b.gnis_id and a.family = b.family where {_M} < 5000
  union all select a.id, b.id, {_M}, 'name_kind_distance' from a join b on a.key = b.key and a.family = b.family where a.key not in {_GENERIC} and (b.gnis_id is null or a.gnis_id = b.gnis_id) and not coalesce(b.match_ambiguous, false) and abs(a.lat - b.lat) < 0.01 and {_M} <= {_LIMIT})
  select id_a, id_b, min(reason) as reason, cast(floor(min(m)) as bigint) as m from p group by 1, 2""")
def _(spark, sf):
    a, b = _land(spark, sf, "USGS GNIS"), _features(spark, sf)
    side = lambda df, s: df.select("gnis_id", "family", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "lon", "lat")))
    ids = side(a, "a").join(side(b, "b"), ["gnis_id", "family"]).withColumn("m", m.flat_m(*(F.col(c) for c in ("lon_a", "lat_a", "lon_b", "lat_b"))))
    ids = ids.filter(F.col("m") < m.SHARED_ID_M).select("id_a", "id_b", "m", F.lit("gnis_id").alias("reason"))
    by_name = m.name_pairs(a, b, ("gnis_id", "match_ambiguous"))
    veto = F.col("gnis_id_b").isNotNull() & ~F.col("gnis_id_a").eqNullSafe(F.col("gnis_id_b"))
    by_name = by_name.filter(~veto & ~F.coalesce("match_ambiguous_b", F.lit(False)) & (F.col("m") <= m.reach_m(F.col("kind_a"))))
    both = ids.unionByName(by_name.select("id_a", "id_b", "m", F.lit("name_kind_distance").alias("reason")))
    return both.groupBy("id_a", "id_b").agg(F.min("reason").alias("reason"), F.floor(F.min("m")).alias("m"))


@query("j06_blocking_keys", f"""with f as ({_records('features', ', gnis_id')}) select id, 'gnis:' || gnis_id as k from f where gnis_id is not null union select id, 'name:' || key from f where key not in {_GENERIC}""")
def _(spark, sf):
    k = F.array_compact(F.array(F.concat(F.lit("gnis:"), "gnis_id"), F.when(~F.col("key").isin(*m.GENERIC), F.concat(F.lit("name:"), "key"))))
    return _features(spark, sf).select("id", F.explode(k).alias("k")).distinct()


_GN = f"""with a as ({_records('landmarks', '', "agency = 'GeoNames'")}), b as ({_records('landmarks', '', "agency = 'USGS GNIS'")}),
  p as (select a.id as id_a, b.id as id_b, a.kind as kind, {_M} as m from a join b on a.key = b.key and {{}} where a.key not in {_GENERIC} and abs(a.lat - b.lat) <= 0.05)"""


@query("j09_gazetteer_match", _GN.format("a.family = b.family") + """, r as (select *, row_number() over (partition by id_a order by m, id_b) as rn from p where m <= case when kind in ('summit', 'rock', 'pass') then 300 else 120 end)
  select id_a, id_b, cast(floor(m) as bigint) as m from r where rn = 1""")
def _(spark, sf):
    p = m.name_pairs(_land(spark, sf, "GeoNames"), _land(spark, sf, "USGS GNIS")).filter(F.col("m") <= m.reach_m(F.col("kind_a")))
    w = Window.partitionBy("id_a").orderBy("m", "id_b")
    return p.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id_a", "id_b", F.floor("m").alias("m"))


@query("j10_survey_match", _GN.format("a.kind = b.kind") + """, s as (select distinct id_a, id_b from p where kind in ('summit', 'rock') and m <= 750), u as (select *, count(*) over (partition by id_a) as na, count(*) over (partition by id_b) as nb from s)
  select id_a, id_b from u where na = 1 and nb = 1""")
def _(spark, sf):
    p = m.name_pairs(_land(spark, sf, "GeoNames"), _land(spark, sf, "USGS GNIS"))
    s = p.filter((F.col("kind_a") == F.col("kind_b")) & F.col("kind_a").isin("summit", "rock") & (F.col("m") <= m.SURVEY_M)).select("id_a", "id_b").distinct()
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    return s.withColumn("na", n("id_a")).withColumn("nb", n("id_b")).filter("na = 1 and nb = 1").select("id_a", "id_b")


_OSM = "select distinct osm_id as id, tags['name'] as name, case when tags['tourism'] = 'camp_site' then 'campground' when tags['highway'] = 'trailhead' then 'trailhead' when tags['natural'] = 'peak' then 'summit' else tags['natural'] end as kind, lon, lat from osm_elements"


def _osm(spark, sf):
    t = F.col("tags")
    kind = F.when(t["tourism"] == "camp_site", "campground").when(t["highway"] == "trailhead", "trailhead").when(t["natural"] == "peak", "summit").otherwise(t["natural"])
    return m.keyed(table(spark, sf, "osm_elements").select(F.col("osm_id").alias("id"), t["name"].alias("name"), kind.alias("kind"), "lon", "lat").distinct().filter("kind is not null"))


_DUP = f"""with o as ({_OSM}), a as (select *, {_KEY} as key, {_FAMILY} as family from o where {_OK} and kind is not null), b as ({_records('features')}),
  p as (select distinct a.id as id_a, b.id as id_b, {_M} as m from a join b on a.key = b.key and a.family = b.family where a.key not in {_GENERIC} and abs(a.lat - b.lat) < 0.01 and {_M} <= {_LIMIT})"""


@query("j11_osm_duplicates", _DUP + """, r as (select *, row_number() over (partition by id_a order by m, id_b) as rn, lead(m) over (partition by id_a order by m, id_b) as nx from p)
  select id_a, id_b, cast(floor(m) as bigint) as m from r where rn = 1 and (nx is null or nx - m >= 30)""")
def _(spark, sf):
    p = m.name_pairs(_osm(spark, sf), _features(spark, sf)).filter(F.col("m") <= m.reach_m(F.col("kind_a"))).select("id_a", "id_b", "m").distinct()
    return m.best_unless_close(p, "id_a").select("id_a", "id_b", F.floor("m").alias("m"))


@query("w06_runner_up", _DUP + ", r as (select *, row_number() over (partition by id_b order by m, id_a) as rn, lead(m) over (partition by id_b order by m, id_a) as nx from p) select id_b, id_a, nx is null or nx - m >= 30 as accepted from r where rn = 1")
def _(spark, sf):
    p = m.name_pairs(_osm(spark, sf), _features(spark, sf)).filter(F.col("m") <= m.reach_m(F.col("kind_a"))).select("id_a", "id_b", "m").distinct()
    w = Window.partitionBy("id_b").orderBy("m", "id_a")
    r = p.withColumn("rn", F.row_number().over(w)).withColumn("nx", F.lead("m").over(w)).filter("rn = 1")
    return r.select("id_b", "id_a", (F.col("nx").isNull() | (F.col("nx") - F.col("m") >= 30)).alias("accepted"))


@query("j13_smallest_area", f"""with p as (select distinct f.id, a.area_id, (a.east - a.west) * (a.north - a.south) as size from facilities f join areas a on f.lon between a.west and a.east and f.lat between a.south and a.north where {_OK}),
  r as (select *, row_number() over (partition by id order by size, area_id) as rn from p) select id, area_id from r where rn = 1""")
def _(spark, sf):
    a = table(spark, sf, "areas")
    inside = containing_regions(table(spark, sf, "facilities").select("id", "lon", "lat"), a).select("id", "area_id").distinct()
    size = ((F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))).alias("size")
    best = F.struct("size", "area_id")
    return inside.join(a.select("area_id", size), "area_id").groupBy("id").agg(F.min(best).alias("b")).select("id", "b.area_id")


@query("j15_tag_enrichment", "select f.id, coalesce(o.w, 'unknown') as water from (select distinct id, gnis_id from features) f left join (select cast(feature_id as varchar) as gnis_id, max(feature_class) as w from landmarks where feature_id is not null group by 1) o on f.gnis_id = o.gnis_id")
def _(spark, sf):
    tags = table(spark, sf, "landmarks").filter("feature_id is not null").groupBy(F.col("feature_id").cast("string").alias("gnis_id")).agg(F.max("feature_class").alias("w"))
    f = table(spark, sf, "features").select("id", "gnis_id").distinct()
    return f.join(tags, "gnis_id", "left").select("id", F.coalesce("w", F.lit("unknown")).alias("water"))


@query("j16_owned_areas", f"""select distinct id from facilities f where {_OK} and not exists (select 1 from areas a where a.name = f.unit and f.lon between a.west - 0.5 and a.east + 0.5 and f.lat between a.south - 0.5 and a.north + 0.5)""")
def _(spark, sf):
    f = table(spark, sf, "facilities").filter(usable(F.col("lon"), F.col("lat")))
    a = table(spark, sf, "areas")
    on = (a["name"] == f["unit"]) & f["lon"].between(a["west"] - 0.5, a["east"] + 0.5) & f["lat"].between(a["south"] - 0.5, a["north"] + 0.5)
    return f.join(a, on, "left_anti").select("id").distinct()


@query("j20_client_match", _DUP + " select id_b as canonical, count(*) as candidates, cast(floor(min(m)) as bigint) as nearest from p group by 1")
def _(spark, sf):
    p = m.name_pairs(_osm(spark, sf), _features(spark, sf)).filter(F.col("m") <= m.reach_m(F.col("kind_a"))).select("id_a", "id_b", "m").distinct()
    return p.groupBy(F.col("id_b").alias("canonical")).agg(F.count("*").alias("candidates"), F.floor(F.min("m")).alias("nearest"))


@query("agg29_match_stats", _DUP + " select count(*) as duplicates, count(distinct id_a) as matched, count(distinct id_b) as groups from p")
def _(spark, sf):
    p = m.name_pairs(_osm(spark, sf), _features(spark, sf)).filter(F.col("m") <= m.reach_m(F.col("kind_a"))).select("id_a", "id_b").distinct()
    return p.agg(F.count("*").alias("duplicates"), F.countDistinct("id_a").alias("matched"), F.countDistinct("id_b").alias("groups"))


@query("j22_osm_representations", f"""with o as (select distinct osm_id as id, elem_type as t, tags['natural'] as icon, {_K.replace('name', "tags['name']")} as k, lon, lat from osm_elements where tags['natural'] is not null and tags['name'] is not null)
  select a.id as id_a, b.id as id_b from o a join o b on a.icon = b.icon and a.k = b.k and a.t < b.t and abs(a.lat - b.lat) < 0.01 where {_M} <= 150""")
def _(spark, sf):
    t = F.col("tags")
    o = table(spark, sf, "osm_elements").filter(t["natural"].isNotNull() & t["name"].isNotNull())
    o = o.select(F.col("osm_id").alias("id"), "elem_type", t["natural"].alias("kind"), t["natural"].alias("family"), name_key(t["name"]).alias("key"), "lon", "lat").distinct()
    p = m.name_pairs(o, o, ("elem_type",))
    return p.filter("elem_type_a < elem_type_b and m <= 150").select("id_a", "id_b").distinct()


@query("j23_display_groups")
def _(spark, sf):
    f = _features(spark, sf).join(table(spark, sf, "features").select("id", "agency", "unit").distinct(), "id").filter("unit <> '' and agency is not null")
    return m.groups_within(f, ["agency", "unit", "kind", "key"], 120.0)


@query("j24_tap_lookup", "select distinct a.id, b.osm_id from features a join osm_elements b on a.name = b.tags['name'] and round(a.lon, 2) = round(b.lon, 2) and round(a.lat, 2) = round(b.lat, 2)")
def _(spark, sf):
    r = lambda c: F.round(c, 2)
    a = table(spark, sf, "features").select("id", F.struct("name", r("lon").alias("x"), r("lat").alias("y")).alias("k"))
    b = table(spark, sf, "osm_elements").select("osm_id", F.struct(F.col("tags")["name"].alias("name"), r("lon").alias("x"), r("lat").alias("y")).alias("k"))
    return a.filter("k.name is not null").join(b, "k").select("id", "osm_id").distinct()


_PEAKS = f"select id, min(lon) as lon, min(lat) as lat, max(elevation_m) as h from landmarks where {_OK} and kind = 'summit' and agency = 'USGS GNIS' and id is not null group by id"
_ANG = "asin(least(1, sqrt(pow(cos(radians(a.lat)) * cos(radians(a.lon)) - cos(radians(b.lat)) * cos(radians(b.lon)), 2) + pow(cos(radians(a.lat)) * sin(radians(a.lon)) - cos(radians(b.lat)) * sin(radians(b.lon)), 2) + pow(sin(radians(a.lat)) - sin(radians(b.lat)), 2)) / 2))"


def _peaks(spark, sf):
    p = table(spark, sf, "landmarks").filter(usable(F.col("lon"), F.col("lat")) & (F.col("kind") == "summit") & (F.col("agency") == "USGS GNIS") & F.col("id").isNotNull())
    return p.groupBy("id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"), F.max("elevation_m").alias("h"))


@query("j18_nearest_other", f"with p as ({_PEAKS}) select a.id, cast(floor(min(2 * 6371.0088 * {_ANG}) * 100) as bigint) as km100 from p a join p b on a.id <> b.id group by 1")
def _(spark, sf):
    return m.nearest_km(_peaks(spark, sf)).select("id", F.floor(F.col("km") * 100).alias("km100"))


@query("j19_nearest_higher", f"with p as (select * from ({_PEAKS}) where h between -500 and 9000) select a.id, cast(floor(min(case when b.id is null then 20015 else 2 * 6371.0088 * {_ANG} end) * 100) as bigint) as km100 from p a left join p b on b.h > a.h group by 1")
def _(spark, sf):
    known = _peaks(spark, sf).filter(F.col("h").between(*rank.KNOWN_HEIGHT))
    return m.nearest_km(known, "h").select("id", F.floor(F.col("km") * 100).alias("km100"))


@query("w02_summit_score", f"""with p as ({_PEAKS}), n as (select a.id, min(2 * 6371.0088 * {_ANG}) as near from p a join p b on a.id <> b.id group by 1),
  g as (select a.id, min(case when b.id is null then 20015 else 2 * 6371.0088 * {_ANG} end) as d from (select * from p where h between -500 and 9000) a left join (select * from p where h between -500 and 9000) b on b.h > a.h group by 1)
  select p.id, cast(floor(case when d is not null then 100 * ln(1 + d) + greatest(0, h) * 0.035 else 35 * ln(1 + near) end * 100) as bigint) as score,
  case when d is null then case when near >= 10 then 11 else 12 end when d >= 250 then 6 when d >= 70 then 7 when d >= 25 then 8 when d >= 8 then 9 when d >= 2 then 10 when d >= 0.7 then 11 when d >= 0.2 then 12 else 13 end as earliest
  from p join n using (id) left join g using (id)""")
def _(spark, sf):
    p = _peaks(spark, sf)
    near = m.nearest_km(p).withColumnRenamed("km", "near")
    higher = m.nearest_km(p.filter(F.col("h").between(*rank.KNOWN_HEIGHT)), "h").withColumnRenamed("km", "higher")
    s = rank.summit_score(F.col("higher"), F.col("near"), F.col("h"))
    return p.join(near, "id").join(higher, "id", "left").select("id", F.floor(s["score"] * 100).alias("score"), s["earliest"].alias("earliest"))


_DEST = f"select id, min(lon) as lon, min(lat) as lat, min(kind) as kind from facilities where {_OK} and kind in ({', '.join(repr(k) for k in rank.DESTINATION)}) and name <> '' group by id"


@query("w03_destination_score", f"""with p as ({_DEST}), n as (select a.id, min(2 * 6371.0088 * {_ANG}) as near from p a join p b on a.id <> b.id group by 1),
  w as (select id, near, case kind {' '.join(f"when '{k}' then {v}" for k, v in rank.DESTINATION.items())} end as w from p join n using (id))
  select id, cast(floor((w + 12 * ln(1 + least(near, 40))) * 100) as bigint) as score, case when near >= 15 and w >= 60 then 9 when near >= 3 and w >= 60 then 10 when w >= 75 then 11 else 12 end as earliest from w""")
def _(spark, sf):
    p = table(spark, sf, "facilities").filter(usable(F.col("lon"), F.col("lat")) & F.col("kind").isin(*rank.DESTINATION) & (F.col("name") != ""))
    p = p.groupBy("id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"), F.min("kind").alias("kind"))
    s = rank.destination_score(F.col("kind"), F.col("km"))
    return p.join(m.nearest_km(p), "id").select("id", F.floor(s["score"] * 100).alias("score"), s["earliest"].alias("earliest"))


@query("w04_landmark_defaults", f"select distinct id, cast(coalesce(case kind {' '.join(f'''when '{k}' then {v}''' for k, v in rank.LANDMARK_SCORE.items())} end, 20) as double) as score, coalesce(case kind {' '.join(f'''when '{k}' then {v}''' for k, v in rank.LANDMARK_ZOOM.items())} end, min_zoom, 14) as earliest from landmarks where kind <> 'summit'")
def _(spark, sf):
    s = rank.landmark_score(F.col("kind"), F.col("min_zoom"))
    return table(spark, sf, "landmarks").filter("kind <> 'summit'").select("id", s["score"].alias("score"), s["earliest"].alias("earliest")).distinct()


@query("w01_label_rank", f"""with p as (select distinct id, kind as family, cast(coalesce(case kind {' '.join(f'''when '{k}' then {v}''' for k, v in rank.LANDMARK_SCORE.items())} end, 20) as double) as score from landmarks)
  select id, family, row_number() over (partition by family order by score desc, id) - 1 as rank from p""")
def _(spark, sf):
    s = rank.landmark_score(F.col("kind"), F.col("min_zoom"))["score"]
    p = table(spark, sf, "landmarks").select("id", F.col("kind").alias("family"), s.alias("score")).distinct()
    return rank.with_rank(p).select("id", "family", "rank")


@query("w05_label_zoom")
def _(spark, sf):
    p = table(spark, sf, "landmarks").filter(usable(F.col("lon"), F.col("lat")) & F.col("id").isNotNull())
    p = p.groupBy("id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"), F.min("kind").alias("kind"), F.min("min_zoom").alias("min_zoom"))
    s = rank.landmark_score(F.col("kind"), F.col("min_zoom"))
    return rank.thin(p.select("id", "lon", "lat", s["score"].alias("score"), s["earliest"].alias("earliest")))


@query("w07_precedence", "select distinct id, case agency when 'NPS' then 0 when 'USFS' then 1 when 'Recreation.gov' then 2 when 'USGS GNIS' then 3 when 'GeoNames' then 4 else 5 end as p from features")
def _(spark, sf):
    p = F.coalesce(lookup(F.col("agency"), {"NPS": 0, "USFS": 1, "Recreation.gov": 2, "USGS GNIS": 3, "GeoNames": 4}), F.lit(5))
    return table(spark, sf, "features").select("id", p.alias("p")).distinct().orderBy("p", "id")  # a range-partitioned sort


@query("x11_area_index", "select regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as k, count(*) as n, array_to_string(list_sort(list(area_id)), ',') as ids from areas group by 1")
def _(spark, sf):
    return table(spark, sf, "areas").groupBy(plain_name(F.col("name")).alias("k")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("area_id")), ",").alias("ids"))
