"""Further queries: contours in view, containment, path context, audits, sieves, schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import usable
from ..functions.geometry import g
from ..operators import audit, delivery, grid, labels, ledger, lines, match, raster, sieve, transfer
from ..session import table
from .ledger import _DEM, _dem, _top
from .match import _M, _OK
from .registry import query


@query("j02_contour_range", f"with d as ({_DEM}) select id, r, c, v from d where v >= 0 and r between 2 and 5 and c between 2 and 5 and (v // 100) % 5 = 0")
def _(spark, sf):
    d = _dem(spark, sf).filter("v >= 0 and r between 2 and 5 and c between 2 and 5")
    return d.filter(F.floor(F.col("v") / 100) % 5 == 0)


@query("j14_nearest_clear", f"""with o as (select distinct osm_id as id, tags['amenity'] as k, lon, lat from osm_elements where tags['amenity'] in ('drinking_water', 'toilets', 'parking')),
  s as (select distinct osm_id as site, lon, lat from osm_elements where tags['tourism'] = 'camp_site'),
  p as (select a.id, b.site, {_M} as m from o a join s b on abs(a.lat - b.lat) < 0.02 where {_M} <= 700), r as (select *, row_number() over (partition by id order by m, site) as rn, lead(m) over (partition by id order by m, site) as nx from p)
  select id, site from r where rn = 1 and (nx is null or nx > m + 50)""")
def _(spark, sf):
    o, t = table(spark, sf, "osm_elements"), F.col("tags")
    base = lambda df, kind: df.select(F.col("osm_id").alias("id"), F.lit("x").alias("kind"), F.lit("site of any name").alias("key"), F.lit("x").alias("family"), "lon", "lat").distinct()
    a = base(o.filter(t["amenity"].isin("drinking_water", "toilets", "parking")), "a")
    b = base(o.filter(t["tourism"] == "camp_site"), "b")
    p = match.name_pairs(a, b).filter("m <= 700")  # one key for all: the cells alone block
    w = Window.partitionBy("id_a").orderBy("m", "id_b")
    r = p.withColumn("rn", F.row_number().over(w)).withColumn("nx", F.lead("m").over(w)).filter("rn = 1 and (nx is null or nx > m + 50)")
    return r.select(F.col("id_a").alias("id"), F.col("id_b").alias("site"))


@query("j17_area_labels", "select area_id, cast(floor((west + east) / 2) as bigint) as cx, cast(floor((south + north) / 2) as bigint) as cy from areas where (west + east) / 2 >= -110 and (west + east) / 2 < -90")
def _(spark, sf):
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    return table(spark, sf, "areas").filter((x >= -110) & (x < -90)).select("area_id", F.floor(x).alias("cx"), F.floor(y).alias("cy"))


@query("p14_route_bounds", f"select distinct id, case when lon between -125 and -116 and lat between 32 and 50 then 'PCT' else '' end as route from landmarks where {_OK}")
def _(spark, sf):
    l = table(spark, sf, "landmarks").filter(usable(F.col("lon"), F.col("lat")))  # noqa: E741
    return l.select("id", F.when(F.col("lon").between(-125, -116) & F.col("lat").between(32, 50), "PCT").otherwise("").alias("route")).distinct()


@query("f12_tile_bounds", "select x, degrees(atan(sinh(pi() * (1 - 2 * x / 256.0)))) > 0 as north from (select unnest(range(256)) as x)")
def _(spark, sf):
    from ..functions.mercator import inverse_lat

    return spark.range(256).select(F.col("id").alias("x"), (inverse_lat(F.col("id") / 256) > 0).alias("north"))


_SQ = "select l_orderkey % 40 as c, l_partkey % 300 as x, l_suppkey % 100 as y, count(*) as m from lineitem group by 1, 2, 3"


@query("pc01_street_density", f"with s as ({_SQ}) select a.c, a.x, a.y, cast(sum(b.m) as bigint) as mass, sum(b.m) >= 12 as urban from s a join s b on a.c = b.c and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9 group by 1, 2, 3")
def _(spark, sf):
    s = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("id"), (F.col("l_partkey") % 300).alias("r"), (F.col("l_suppkey") % 100).alias("c")).agg(F.count("*").alias("v"))
    d = raster.disk_sum(s, 3)
    return d.select(F.col("id").alias("c"), F.col("r").alias("x"), F.col("c").alias("y"), F.col("s").alias("mass"), (F.col("s") >= 12).alias("urban"))


@query("pc03_path_context", "with p as (select l_orderkey, count(*) filter (l_partkey % 3 > 0) = count(*) as urban, bool_or(l_suppkey % 7 = 0) as developed from lineitem group by 1) select * from p")
def _(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_orderkey")
    return p.agg(F.bool_and(F.col("l_partkey") % 3 > 0).alias("urban"), F.bool_or(F.col("l_suppkey") % 7 == 0).alias("developed"))


_ENDS = "select l_orderkey * 10 + l_linenumber as id, l_linenumber % 3 as a, (l_partkey % 500) * 10 as x, l_orderkey % 200 as y from lineitem union all select l_orderkey * 10 + l_linenumber, l_linenumber % 3, (l_partkey % 500) * 10 + 50 + cast(l_quantity as bigint) * 5, l_orderkey % 200 from lineitem"


@query("q01_connectivity", f"with e as ({_ENDS}), n as (select x, y, count(distinct id) as lines, count(distinct a) as sources from e group by 1, 2) select x, y, case when lines = 1 then 'dead end' when sources = 1 then 'duplicate terminus' else 'junction' end as kind from n")
def _(spark, sf):
    l, c = table(spark, sf, "lineitem"), F.col  # noqa: E741
    x = (c("l_partkey") % 500) * 10
    e = l.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_linenumber") % 3).alias("source"), (c("l_orderkey") % 200).alias("y"), F.explode(F.array(x, x + 50 + c("l_quantity").cast("bigint") * 5)).alias("x"))
    return audit.connectivity(e)


_ROADS = "with s as (select l_orderkey * 100 + l_linenumber as id, (l_partkey % 500) * 10 as x0, (l_partkey % 500) * 10 + 50 + cast(l_quantity as bigint) * 5 as x1, l_orderkey % 200 as b, (l_linenumber * 7) % 20 as y from lineitem)"


@query("q03_road_duplicates", _ROADS + " select a.id as id_a, b.id as id_b, least(a.x1, b.x1) - greatest(a.x0, b.x0) as shared from s a join s b on a.b = b.b and a.id < b.id and abs(a.y - b.y) <= 1 where least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 30 and (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * 10 >= least(a.x1 - a.x0, b.x1 - b.x0) * 7")
def _(spark, sf):
    c = F.col
    x0 = (c("l_partkey") % 500) * 10
    s = table(spark, sf, "lineitem").select((c("l_orderkey") * 100 + c("l_linenumber")).alias("id"), x0.alias("x0"), (x0 + 50 + c("l_quantity").cast("bigint") * 5).alias("x1"), (c("l_orderkey") % 200).alias("b"), ((c("l_linenumber") * 7) % 20).alias("y"))
    return audit.parallel_pairs(s, "b", 1, 30, 0.7)


@query("q04_conflict_triage", "select round(lon / 5) as cell, kind, count(distinct match_group) as groups from features where match_group is not null and lon is not null group by 1, 2")
def _(spark, sf):
    f = table(spark, sf, "features").filter("match_group is not null and lon is not null")
    return f.groupBy(F.round(F.col("lon") / 5).alias("cell"), "kind").agg(F.countDistinct("match_group").alias("groups"))


@query("q06_alignment", "with p as (select user_id, event_id, row_number() over w as x, floor(value) as y, lead(floor(value)) over w as ny from events window w as (partition by user_id order by ts, event_id)), s as (select user_id, sqrt(9 + (ny - y) * (ny - y)) as d from p where ny is not null) select user_id, cast(floor(sum(d) * 100 + 1e-6) as bigint) as length, cast(floor(quantile_cont(d, 0.5) * 1000 + 1e-6) as bigint) as spacing from s group by 1")
def _(spark, sf):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    p = table(spark, sf, "events").select("user_id", (rn * 3).alias("x"), F.floor("value").alias("y"))
    a = audit.alignment(p, ["user_id"], "x")
    return a.select("user_id", F.floor(F.col("length") * 100 + 1e-6).alias("length"), F.floor(F.col("spacing") * 1000 + 1e-6).alias("spacing"))


@query("q07_review_inputs", f"select id, kind from (select distinct id, kind, cast(floor((lon + 180) / 360 * 16384) as bigint) as x from features where {_OK}) where x between 3000 and 4000")
def _(spark, sf):
    f = grid.assign(table(spark, sf, "features").filter(usable(F.col("lon"), F.col("lat"))), 14)
    return f.filter("x between 3000 and 4000").select("id", "kind").distinct()


@query("q09_dem_audit", f"with d as (select id, count(*) filter (v > 0) as n from ({_DEM}) group by 1), p as (select p_partkey % (select max(vec_id) + 1 from embeddings) as cell from part) select cell, coalesce(n >= 20, false) as covered, count(*) as labels from p left join d on d.id = cell group by 1, 2")
def _(spark, sf):
    d = _dem(spark, sf).groupBy("id").agg(F.count_if(F.col("v") > 0).alias("n"))
    p = table(spark, sf, "part").select((F.col("p_partkey") % _top(spark, sf, "embeddings", "vec_id")).alias("id"))
    covered = F.coalesce(F.col("n") >= 20, F.lit(False))  # a missing block covers nothing
    return p.join(d, "id", "left").groupBy(F.col("id").alias("cell"), covered.alias("covered")).agg(F.count("*").alias("labels"))


@query("q13_seams", f"""with d as (select id, r, c, v, cast(floor(v / 100.0) as bigint) as k from ({_DEM})), n as (select *, lead(k) over (partition by id, c order by r) as below from d), x as (select id, c, r, unnest(range(least(k, below) + 1, greatest(k, below) + 1)) as level from n where below is not null and k <> below)
  select e.id, count(*) as crossings, count(*) filter (w.id is null) as open from x e left join x w on w.id = e.id + 1 and w.r = e.r and w.level = e.level and w.c = 0 where e.c = 7 group by 1""")
def _(spark, sf):
    return audit.seams(_dem(spark, sf), 8, 100)


@query("r04_mosaic", f"with d as ({_DEM}) select id // 2 as pair, r, cast((id % 2) * 8 + c as int) as c, v from d where id // 2 >= 0 and (id % 2) * 8 + c between 3 and 12 and r between 1 and 6")
def _(spark, sf):
    i = F.col("id")
    chunks = _dem(spark, sf).select(F.floor(i / 2).alias("pair"), F.lit(0).alias("cy"), (i % 2).alias("cx"), "r", "c", "v")
    return raster.mosaic(chunks, ["pair"], 8, (1, 6), (3, 12)).select("pair", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v")


@query("r09_resample", f"""with d as (select id, r, c, case when v > -80 then v end as v from ({_DEM})), m as (select id, floor(avg(v)) as coarse from d group by 1)
  select a.id, a.r, a.c, cast(floor(coalesce(a.v * 0.375 + b.v * 0.125 + c.v * 0.375 + e.v * 0.125, coarse) * 8) as bigint) as v8 from d a join d b on b.id = a.id and b.r = a.r and b.c = a.c + 1
  join d c on c.id = a.id and c.r = a.r + 1 and c.c = a.c join d e on e.id = a.id and e.r = a.r + 1 and e.c = a.c + 1 join m on m.id = a.id where coalesce(a.v * 0.375 + b.v * 0.125 + c.v * 0.375 + e.v * 0.125, coarse) is not null""")
def _(spark, sf):
    """Samples a quarter to the east and half to the south of each cell; what a missing neighbour leaves open takes the block's coarse value."""
    d = _dem(spark, sf).withColumn("v", F.when(F.col("v") > -80, F.col("v")))
    coarse = d.groupBy("id").agg(F.floor(F.avg("v")).alias("coarse"))
    out = raster.resampled(d, 0.25, 0.5, coarse).filter("v is not null")
    return out.select("id", "r", "c", F.floor(F.col("v") * 8).cast("bigint").alias("v8"))


@query("r12_sieve")
def _(spark, sf):
    """Land-cover codes with regions of fewer than four pixels given to their largest neighbour."""
    codes = _dem(spark, sf).select("id", "r", "c", F.when(F.col("v") > 60, 41).when(F.col("v") < -60, 21).otherwise(71).alias("v"))
    return sieve.sieved(codes, 4)


@query("r13_polygons", f"with d as (select id, r, c, case when v > 60 then 41 when v < -60 then 21 else 71 end as code from ({_DEM})) select id, code, cast(count(*) as bigint) as area from d group by 1, 2")
def _(spark, sf):
    codes = _dem(spark, sf).select("id", "r", "c", F.when(F.col("v") > 60, 41).when(F.col("v") < -60, 21).otherwise(71).alias("v"))
    p = sieve.polygons(codes)
    return p.groupBy("id", F.col("v").alias("code")).agg(F.round(F.sum(g("Area", F.col("shape")))).cast("bigint").alias("area"))


@query("r19_device_coverage", f"with d as ({_DEM}) select p_partkey, exists(select 1 from d where d.id = p_partkey % 700 and v > 300) as covered from part")
def _(spark, sf):
    d = _dem(spark, sf).filter("v > 300").select("id").distinct().withColumn("hit", F.lit(True))
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 700).alias("id"))
    return p.join(d, "id", "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("covered"))


@query("so07_report_order", "select kind, state_name, count(*) as n from landmarks group by 1, 2 order by n desc, kind, state_name limit 25")
def _(spark, sf):
    return table(spark, sf, "landmarks").groupBy("kind", "state_name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kind", "state_name").limit(25)


@query("st08_edge_quota", "with e as (select user_id, event_id, ts, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as m from events), g as (select *, sum(case when m <= 3 then 1 else 0 end) over (partition by user_id, strftime(ts, '%Y-%m') order by ts, event_id) as total from e) select event_id, m <= 3 and total <= 40 as granted from g")
def _(spark, sf):
    """At most three requests an hour and forty a month; what is refused uses nothing."""
    return ledger.two_limits(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts")), 3, F.date_format("ts", "yyyy-MM"), 40).select("event_id", "granted")


@query("st09_viewport_queue", """with n as (select max(ts) as now from events), r as (select event_id % 500 as tile, max(ts) as seen, max(case when event_type = 'error' then ts end) as failed from events group by 1),
  w as (select tile, seen, row_number() over (order by seen desc, tile) as pos from r, n where seen >= now - interval 20 day and (failed is null or failed < now - interval 5 day)) select tile, cast(pos as int) as pos from w where pos <= 64""")
def _(spark, sf):
    """Tiles looked at in the last twenty days and not failed in the last five, newest first, the 64 that may wait."""
    e = table(spark, sf, "events")
    seen = e.groupBy((F.col("event_id") % 500).alias("tile")).agg(F.max("ts").alias("seen"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("failed"))
    now = e.agg(F.max("ts")).first()[0]
    waiting, _ = ledger.viewport_queue(seen, F.lit(now), 20 * 86400, 5 * 86400, 64)
    return waiting.select("tile", "pos")


@query("l13_extent_halo", "select osm_id, dx from (select distinct osm_id, floor(lon * 10) as cx from osm_elements where lon is not null) , (select unnest([-1, 0, 1]) as dx)")
def _(spark, sf):
    o = table(spark, sf, "osm_elements").filter("lon is not null").select("osm_id", F.floor(F.col("lon") * 10).alias("cx")).distinct()
    return o.select("osm_id", F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1)))).alias("dx"))


@query("w13_label_zoom", "select area_id, (select min(z) / 10.0 from (select unnest(range(50, 221)) as z) where (east - west) / 360 * pow(2, z / 10.0) * 512 >= length(name) * 0.68 * 12) as zoom from areas")
def _(spark, sf):
    return table(spark, sf, "areas").select("area_id", labels.label_zoom((F.col("east") - F.col("west")) / 360, F.col("name")).alias("zoom"))


@query("w14_declutter", "with p as (select distinct osm_id, round(lon, 3) as x, round(lat, 3) as y from osm_elements), r as (select *, row_number() over (partition by x, y order by osm_id) - 1 as slot from p) select osm_id, slot, cast(floor(sqrt(slot) * 20 * cos(slot * 2.399963229728653) * 1000 + 0.5) as bigint) as dx from r")
def _(spark, sf):
    p = table(spark, sf, "osm_elements").select(F.col("osm_id").alias("id"), F.round("lon", 3).alias("x"), F.round("lat", 3).alias("y")).distinct()
    return labels.apart(p, F.col("x"), F.col("y")).select(F.col("id").alias("osm_id"), "slot", F.floor(F.col("dx") * 1000 + 0.5).alias("dx"))


@query("x02_warm_gate", "select o_orderkey, case when o_totalprice < 100000 then false when o_orderstatus = 'O' then false else o_custkey % 100 >= 30 end as warm from orders")
def _(spark, sf):
    c = F.col
    warm = transfer.may_warm(c("o_totalprice"), F.lit(100_000.0), c("o_orderstatus") == "O", (c("o_custkey") % 100).cast("double"), 30.0)
    return table(spark, sf, "orders").select("o_orderkey", warm.alias("warm"))


@query("x05_extent", "select area_id, not (east < -120 or west > -100 or north < 30 or south > 45) as covered from areas")
def _(spark, sf):
    c = F.col
    return table(spark, sf, "areas").select("area_id", delivery.meets(c("west"), c("south"), c("east"), c("north"), (-120.0, 30.0, -100.0, 45.0)).alias("covered"))


@query("x07_street_filter", "select l_orderkey, l_linenumber from lineitem where ['residential', 'track', 'primary', 'path', 'living_street'][1 + l_partkey % 5] in ('residential', 'unclassified', 'tertiary', 'secondary', 'primary', 'motorway', 'trunk', 'living_street')")
def _(spark, sf):
    k = F.expr("element_at(array('residential', 'track', 'primary', 'path', 'living_street'), cast(1 + l_partkey % 5 as int))")
    return table(spark, sf, "lineitem").filter(k.isin("residential", "unclassified", "tertiary", "secondary", "primary", "motorway", "trunk", "living_street")).select("l_orderkey", "l_linenumber")


@query("x14_priority_queue", "select o_orderkey from orders where o_orderstatus = 'P' order by o_orderpriority, o_orderkey limit 16")
def _(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'P'").orderBy("o_orderpriority", "o_orderkey").limit(16).select("o_orderkey")


@query("x18_world_wrap", "select id, cast(floor(((lon + 180) / 360 - floor((lon + 180) / 360)) * 1e6) as bigint) as x from (select distinct id, lon from facilities where lon is not null)")
def _(spark, sf):
    f = table(spark, sf, "facilities").filter("lon is not null").select("id", "lon").distinct()
    return f.select("id", F.floor(delivery.world_wrapped(F.col("lon")) * 1e6).alias("x"))


@query("x29_resample", "with s as (select l_orderkey * 100 + l_linenumber as id, 50 + cast(l_quantity as bigint) * 5 as len from lineitem) select id, cast(ceil(len / 25.0) as bigint) as points from s")
def _(spark, sf):
    n = 50 + F.col("l_quantity").cast("bigint") * 5
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.size(lines.stations(n)).cast("bigint").alias("points"))

