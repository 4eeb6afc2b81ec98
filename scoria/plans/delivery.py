"""Queries of source records, transfers, delivered tiles and the composed network, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions.geo import usable
from ..functions.geometry import box, g, register
from ..operators import classify, delivery, network, records, shapes, transfer
from ..session import table
from .ledger import _TASKS, _tasks
from .match import _OK
from .registry import query
from .shapes import _SEG, _areas, _round, _seg

c = F.col


def _records(f):
    return records.records(c("source_records"), c("id"), c("agency"), c("name"))


# Records as JSON, or the feature's own where there are none.
_RECORDS = """f as (select distinct id, agency, name, match_group, ingested_at, kind, case when json_valid(source_records) then source_records end as s from features),
  n as (select *, coalesce(try_cast(json_array_length(s) as int), 0) as k from f),
  r as (select id as fid, match_group, ingested_at, kind, agency as fagency, json_extract_string(j, '$.id') as id, json_extract_string(j, '$.agency') as agency, json_extract_string(j, '$.name') as name,
      json_extract_string(j, '$.details.phone') as phone, i from (select *, unnest(cast(json_extract(s, '$[*]') as json[])) as j, unnest(range(k)) as i from n where k > 0)
    union all select id, match_group, ingested_at, kind, agency, id, agency, name, null, 0 from n where k = 0)"""


@query("c11_records", f"with {_RECORDS} select fid, i, id, agency, name from r")
def _(spark, sf):
    f = table(spark, sf, "features").select("id", "agency", "name", "match_group", "ingested_at", "kind", "source_records").distinct()
    r = f.select(c("id").alias("fid"), F.posexplode(_records(f)).alias("i", "r"))
    return r.select("fid", "i", c("r.id").alias("id"), c("r.agency").alias("agency"), c("r.name").alias("name"))


@query("c02_original", f"with {_RECORDS} select fid as id, max(phone) as phone, count(*) as own from r where id = fid and agency = fagency group by fid, match_group, ingested_at, kind, fagency")
def _(spark, sf):
    f = table(spark, sf, "features").select("id", "agency", "name", "match_group", "ingested_at", "kind", "source_records").distinct()
    r = _records(f)
    own = F.filter(r, lambda x: (x["id"] == c("id")) & (x["agency"] == c("agency")))
    f = f.withColumn("details", records.original(r, c("id"), c("agency"))).withColumn("own", F.size(own).cast("bigint")).filter("own > 0")
    return f.select("id", c("details")["phone"].alias("phone"), "own")


@query("agg08_records", f"with {_RECORDS} select match_group, count(*) as source_count from (select distinct match_group, agency, id from r where match_group is not null) group by 1")
def _(spark, sf):
    f = table(spark, sf, "features").filter("match_group is not null")
    parts = f.select("match_group", "ingested_at", _records(f).alias("records"))
    return records.merge_records(parts, ["match_group"], order="ingested_at").select("match_group", "source_count")


@query("q10_icons", """with f as (select distinct match_group as gid, kind from features where match_group is not null),
  s as (select distinct gid, k from (select match_group as gid, kind as k from features where match_group is not null union all select match_group, json_extract_string(j, '$.details.kind') from (select match_group,
    unnest(cast(json_extract(case when json_valid(source_records) then source_records end, '$[*]') as json[])) as j from features where match_group is not null)) where k is not null)
  select gid, array_to_string(list_sort(coalesce(list(k) filter (not exists (select 1 from f where f.gid = s.gid and f.kind = s.k)), [])), ',') as missing from s group by 1""")
def _(spark, sf):
    """Kinds that a group's source records name and that no member of it is."""
    f = table(spark, sf, "features").filter("match_group is not null").withColumn("gid", c("match_group"))
    said = F.transform(_records(f), lambda r: r["details"]["kind"])
    groups = f.select("gid", F.array_compact(F.concat(F.array("kind"), said)).alias("icons"))
    members = f.select("gid", c("kind").alias("icon"), F.lit(None).cast("array<string>").alias("icons"))
    return records.missing_icons(members, groups, "gid").select("gid", F.array_join("missing", ",").alias("missing"))


_SURFACES = "['AC - Asphalt', 'paved', 'Gravel', ' concrete ', 'PCC - slab', 'NAT - native', 'BST - chip', '']"


@query("p16_paved", f"select l_orderkey, l_linenumber, upper(trim(s)) in ('ASPHALT', 'PAVED', 'CONCRETE') or upper(trim(s)) like 'AC -%' or upper(trim(s)) like 'BST -%' or upper(trim(s)) like 'PCC -%' as paved from (select l_orderkey, l_linenumber, {_SURFACES}[1 + l_partkey % 8] as s from lineitem)")
def _(spark, sf):
    surface = F.expr(f"element_at(array({_SURFACES[1:-1]}), cast(1 + l_partkey % 8 as int))")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", classify.paved(surface).alias("paved"))


@query("f23_popup", """select doc_id, left(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'), ' '), 80) as shown from documents where regexp_matches(text, '^[\\x20-\\x7e\\n]*$')""")
def _(spark, sf):
    """The start of plain texts as a popup shows it."""
    d = table(spark, sf, "documents").filter(c("text").rlike(r"^[\x20-\x7e\n]*$"))
    return d.select("doc_id", names.clean_text(c("text"), 80).alias("shown"))


_HEADERS = "['gzip', 'gzip;q=0', 'br;q=1.0, gzip;q=0.5', '*', 'GZIP ; q=0.000', 'identity', 'gzip;q=x', 'deflate,  gzip', '']"


@query("p29_gzip", f"select o_orderkey, h in ('gzip', 'br;q=1.0, gzip;q=0.5', 'deflate,  gzip') as taken from (select o_orderkey, {_HEADERS}[1 + o_custkey % 9] as h from orders)")
def _(spark, sf):
    header = F.expr(f"element_at(array({_HEADERS[1:-1]}), cast(1 + o_custkey % 9 as int))")
    return table(spark, sf, "orders").select("o_orderkey", transfer.accepts_gzip(header).alias("taken"))


def _cells(spark, sf):
    """Ids of landmarks by degree cells, as a source that is asked cell by cell has them."""
    l = table(spark, sf, "landmarks").filter(usable(c("lon"), c("lat")) & c("feature_id").isNotNull())  # noqa: E741
    return l.select(F.floor("lon").alias("x"), F.floor("lat").alias("y"), "feature_id").distinct()


_CELLS = f"select distinct cast(floor(lon) as bigint) as x, cast(floor(lat) as bigint) as y, feature_id from landmarks where {_OK} and feature_id is not null"


def _paged_sql(size: int, most: int) -> str:
    return f"""with t as ({_CELLS}), n as (select *, row_number() over (partition by x, y order by feature_id) - 1 as pos, count(*) over (partition by x, y) as total from t)
      select x, y, cast(pos // {size} as bigint) as page, total > {most} as exceeded, count(*) as n, min(feature_id) as low, max(feature_id) as high from n group by 1, 2, 3, 4"""


def _paged(spark, sf, size, most):
    p = transfer.paged(_cells(spark, sf), ["x", "y"], "feature_id", size, most)
    return p.select("x", "y", "page", "exceeded", F.size("ids").cast("bigint").alias("n"), F.array_min("ids").alias("low"), F.array_max("ids").alias("high"))


@query("src05_id_pages", _paged_sql(100, 10_000))
def _(spark, sf):
    return _paged(spark, sf, 100, 10_000)


@query("src06_boundary_ids", _paged_sql(1, 300))
def _(spark, sf):
    return _paged(spark, sf, 1, 300)


@query("src24_area_pages", _paged_sql(50, 1_000_000_000))
def _(spark, sf):
    return _paged(spark, sf, 50, 1_000_000_000)


@query("src07_short_pages", f"with t as ({_CELLS}), n as (select *, (row_number() over (partition by x, y order by feature_id) - 1) // 2000 as page from t) select x, y, cast(page as bigint) as page, count(*) as wanted, count(*) filter (feature_id % 100 <> 7) as got from n group by 1, 2, 3 having count(*) filter (feature_id % 100 = 7) > 0")
def _(spark, sf):
    """Pages that came back short, where every hundredth object is lost."""
    ids = _cells(spark, sf)
    return transfer.short_pages(transfer.paged(ids, ["x", "y"], "feature_id", 2000, 10**9), ids.filter("feature_id % 100 <> 7"), ["x", "y"], "feature_id")


@query("src19_metatiles", "select distinct x, y, x // 16 as px, y // 16 as py, x % 16 as dx, y % 16 as dy from (select cast(p_partkey % 1000 as bigint) as x, cast(p_partkey // 7 as bigint) as y from part)")
def _(spark, sf):
    tiles = table(spark, sf, "part").select((c("p_partkey") % 1000).alias("x"), F.floor(c("p_partkey") / 7).alias("y")).distinct()
    return transfer.metatiles(tiles)


@query("src23_resume", "select doc_id, least(doc_id % 3000, n_chars) as have, case when doc_id % 3000 >= n_chars then md5(text) = md5(case when doc_id % 2 = 0 then text else text || 'x' end) end as sound from documents where text is not null and n_chars is not null")
def _(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null and n_chars is not null")
    expected = F.md5(F.when(c("doc_id") % 2 == 0, c("text")).otherwise(F.concat("text", F.lit("x"))))
    r = transfer.resume(c("n_chars").cast("bigint"), c("doc_id") % 3000, c("text"), expected)
    return d.select("doc_id", r["offset"].alias("have"), r["sound"].alias("sound"))


@query("snk07_puts", f"with t as ({_TASKS}) select key, case when key % 10 = 3 then 'changed' when status = 'done' and key % 4 <> 0 then 'skip' else 'upload' end as action from t")
def _(spark, sf):
    t = _tasks(spark, sf)
    sha, known = F.sha1(c("key").cast("string")), c("key") % 4 != 0
    changed = c("key") % 10 == 3
    old_size, old_sha = F.when(known | changed, c("size")), F.when(changed, F.lit("other")).when(known, sha)
    return t.select("key", transfer.put_action(c("size"), sha, old_size, old_sha, F.when(known, c("status") == "done")).alias("action"))


@query("snk10_gps_batches", "with e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events) select user_id, cast(pos // 50 as bigint) as batch, count(*) as n, md5(string_agg(chr(10) || '{\"id\":' || event_id || '}', '' order by pos)) as digest from e group by 1, 2")
def _(spark, sf):
    line = F.concat(F.lit('{"id":'), c("event_id").cast("string"), F.lit("}"))
    b = transfer.batches(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], line)
    return b.select("user_id", "batch", "n", F.md5("text").alias("digest"))


@query("snk12_batches", "select l_orderkey, case when l_orderkey % 11 = 0 then 409 when count(*) > 4 or count(distinct k) <> count(*) then 400 else 200 end as status from (select l_orderkey, l_partkey % 40 as k from lineitem) group by 1")
def _(spark, sf):
    keys = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(c("l_partkey") % 40).alias("k"))
    dataset = F.when(c("l_orderkey") % 11 == 0, "old").otherwise("new")
    return keys.select("l_orderkey", transfer.batch_status(c("k"), dataset, F.lit("new"), 4).alias("status"))


@query("l12_reuse", f"with t as ({_TASKS}) select key, case when attempts = 5 then 'cached' when attempts > 0 and size % 2 = 0 then 'rebuild' else 'fetch' end as action from t")
def _(spark, sf):
    t = _tasks(spark, sf)
    return t.select("key", transfer.reuse(F.lit(5), F.when(c("attempts") > 0, c("attempts")), c("size") % 2 == 0).alias("action"))


@query("l15_limits", f"with t as ({_TASKS}) select source, case when count(*) % 3 = 0 then 'disk' when sum(size) * 1000 > 25000000000 then 'spool' end as paused from t group by 1")
def _(spark, sf):
    t = _tasks(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    free = F.when(c("n") % 3 == 0, F.lit(49 * 10**9)).otherwise(F.lit(51 * 10**9))
    return t.select("source", transfer.paused(free, c("bytes") * 1000).alias("paused"))


@query("x16_limits", "select o_orderkey, o_orderkey % 7 <> 0 and o_custkey % 5 <> 0 and o_orderkey % 13 <> 0 as valid from orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    limits = F.array(F.when(c("o_orderkey") % 7 == 0, F.lit("-1")).otherwise(c("o_custkey").cast("string")), F.lit("0"))
    roles = F.array(F.lit("client"), F.when(c("o_custkey") % 5 == 0, "admin").otherwise("warm"))
    digests = F.array(F.when(c("o_orderkey") % 13 == 0, "short").otherwise(F.sha2(c("o_orderkey").cast("string"), 256)))
    return o.select("o_orderkey", transfer.valid_limits(limits, roles, digests).alias("valid"))


@query("x30_tile_action", f"with t as ({_TASKS}) select key, case when status = 'done' then 'skip' when attempts > 2 and size % 5 <> 0 then 'reuse' else 'render' end as action from t")
def _(spark, sf):
    return _tasks(spark, sf).select("key", transfer.tile_action(c("status") == "done", c("attempts") > 2, c("size") % 5 != 0).alias("action"))


@query("agg25_fingerprint", "select kind, sha256(string_agg(name || coalesce(designation, ''), '' order by name, coalesce(designation, ''))) as hash from areas where name is not null group by 1")
def _(spark, sf):
    a = table(spark, sf, "areas").filter("name is not null").withColumn("d", F.coalesce("designation", F.lit("")))
    return transfer.fingerprint(a, ["kind"], "name", "d")


@query("f21_working_path", "select l_orderkey, l_linenumber, case when l_linenumber = 1 or l_partkey % 3 = 0 then p when l_partkey % 3 = 1 then '/scratch/source-cache/' || l_partkey || '.json' else p end as path from (select *, case l_partkey % 3 when 1 then '/data/' || l_partkey || '.json' when 2 then '/other/' || l_partkey || '.json' else '/scratch/' || l_partkey || '.json' end as p from lineitem)")
def _(spark, sf):
    folder = F.when(c("l_partkey") % 3 == 1, "/data/").when(c("l_partkey") % 3 == 2, "/other/").otherwise("/scratch/")
    path = F.concat(folder, c("l_partkey").cast("string"), F.lit(".json"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", transfer.working_path(path, "/data", "/scratch", c("l_linenumber") == 1).alias("path"))


@query("st10_render_order", "select event_id, user_id, cast((row_number() over (partition by user_id order by case when event_type = 'view' then 0 else 1 end, ts, event_id) - 1) // 4 as bigint) as turn from events")
def _(spark, sf):
    e = table(spark, sf, "events").select(c("event_id").alias("id"), c("ts").alias("at"), c("user_id").alias("gate"), (c("event_type") != "view").alias("background"))
    return transfer.render_order(e, 4).select(c("id").alias("event_id"), c("gate").alias("user_id"), "turn")


@query("x06_contour_bounds", "select p_partkey, case when z between 11 and 14 and x < 2 ** z and y < 2 ** z then cast(floor(x / 2 ** z * 1e9) as bigint) end as west, case when z between 11 and 14 and x < 2 ** z and y < 2 ** z then cast(floor((y + 1) / 2 ** z * 1e9) as bigint) end as south from (select p_partkey, cast(9 + p_partkey % 7 as int) as z, p_partkey % 3000 as x, p_partkey % 2500 as y from part)")
def _(spark, sf):
    z, x, y = (9 + c("p_partkey") % 7).cast("int"), c("p_partkey") % 3000, c("p_partkey") % 2500
    b = delivery.contour_bounds(z, x, y)
    return table(spark, sf, "part").select("p_partkey", F.floor(b["west"] * 1e9).cast("bigint").alias("west"), F.floor(b["south"] * 1e9).cast("bigint").alias("south"))


_WORLD_Y = "(0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi()))"


@query("x19_cell_keys", f"""with p as (select distinct cast(floor((lon + 180) / 360 * 4096) as bigint) as x, cast(floor({_WORLD_Y} * 4096) as bigint) as y from facilities where {_OK} and abs(lat) < 85)
  select distinct z, x >> (12 - z) as x, y >> (12 - z) as y from p, (select unnest([6, 7, 8, 9, 10, 11, 12]) as z)
  union select z, (x << (z - 12)) + dx, (y << (z - 12)) + dy from p, (select unnest([13, 14]) as z), (select unnest(range(4)) as dx), (select unnest(range(4)) as dy) where dx < (1 << (z - 12)) and dy < (1 << (z - 12))""")
def _(spark, sf):
    f = table(spark, sf, "facilities").filter(usable(c("lon"), c("lat")) & (F.abs("lat") < 85))
    return delivery.cell_keys(f.select("lon", "lat")).select(c("z").cast("int").alias("z"), c("x").cast("bigint").alias("x"), c("y").cast("bigint").alias("y"))


@query("x21_download_grid", """with a as (select area_id, cast(floor((east + 180) / 360 * 4096) as bigint) - cast(floor((west + 180) / 360 * 4096) as bigint) + 1 as columns,
    cast(floor((0.5 - ln((1 + sin(radians(south))) / (1 - sin(radians(south)))) / (4 * pi())) * 4096) as bigint) - cast(floor((0.5 - ln((1 + sin(radians(north))) / (1 - sin(radians(north)))) / (4 * pi())) * 4096) as bigint) + 1 as rows from areas)
  select area_id, columns, rows, cast(floor(case when columns * rows > 600 and greatest(columns, rows) > 20 then least(18, 6 + log2(greatest(columns, rows) / 20)) else 6 end * 1e6 + 0.5) as bigint) as zoom6 from a""")
def _(spark, sf):
    d = delivery.download_grid(c("west"), c("south"), c("east"), c("north"), F.lit(6.0))
    return table(spark, sf, "areas").select("area_id", d["columns"].alias("columns"), d["rows"].alias("rows"), F.floor(d["zoom"] * 1e6 + 0.5).cast("bigint").alias("zoom6"))


@query("x24_progress", """select o_orderkey, case when size >= 1000000000 then printf('%.2f GB', size / 1e9) else printf('%.2f MB', size / 1e6) end as bytes, case when total > 0 then least(100, cast(floor(done / total * 100 + 0.5) as int)) else 0 end as percent,
    'Area near ' || printf('%.2f', abs(lat)) || '°' || case when lat < 0 then 'S' else 'N' end || ', ' || printf('%.2f', abs(lon)) || '°' || case when lon < 0 then 'W' else 'E' end as area
  from (select o_orderkey, cast(o_custkey as double) * 12345679 as size, o_custkey % 90 as done, o_orderkey % 100 as total, (o_custkey % 4096 + 0.5) / 4096 * 360 - 180 as lon, degrees(atan(sinh(pi() * (1 - 2 * (o_orderkey % 4096 + 0.5) / 4096)))) as lat from orders)""")
def _(spark, sf):
    size = c("o_custkey").cast("double") * 12345679
    return table(spark, sf, "orders").select(
        "o_orderkey", delivery.bytes_text(size).alias("bytes"), delivery.percent(c("o_custkey") % 90, c("o_orderkey") % 100).alias("percent"),
        delivery.area_text(c("o_custkey") % 4096, c("o_orderkey") % 4096).alias("area"),
    )


@query("x12_directory", "select area_id, to_json({'id': area_id, 'name': name, 'kind': kind}) as entry from areas where name is not null and kind is not null")
def _(spark, sf):
    a = table(spark, sf, "areas").filter("name is not null and kind is not null")
    return a.select("area_id", F.to_json(F.struct(c("area_id").alias("id"), "name", "kind")).alias("entry"))


_FLOW_TAG = "['yes', 'no', null, 'spring', '', 'False', '0']"


@query("x08_waterways", f"""with o as (select distinct elem_id from osm_elements where elem_type = 'way'), t as (select elem_id as way, {_FLOW_TAG}[1 + elem_id % 7] as i, {_FLOW_TAG}[1 + elem_id % 5] as s from o where elem_id % 3 <> 0)
  select o.elem_id as id, case when coalesce(lower(trim(t.s)) not in ('', 'no', 'false', '0', 'none'), false) then 'seasonal' when coalesce(lower(trim(t.i)) not in ('', 'no', 'false', '0', 'none'), false) then 'intermittent'
  when coalesce(t.i in ('no', 'false', '0'), false) or coalesce(t.s in ('no', 'false', '0'), false) then 'perennial' else 'unknown' end as flow from o left join t on t.way = o.elem_id""")
def _(spark, sf):
    tag = lambda k: F.expr(f"element_at(array({_FLOW_TAG[1:-1]}), cast(1 + elem_id % {k} as int))")
    o = table(spark, sf, "osm_elements").filter("elem_type = 'way'").select("elem_id").distinct()
    lines = o.select(c("elem_id").alias("id"), (c("elem_id") + F.shiftleft(F.lit(2).cast("bigint"), 44)).alias("packed"))
    tags = o.filter("elem_id % 3 <> 0").select(c("elem_id").alias("way"), tag(7).alias("intermittent"), tag(5).alias("seasonal"))
    return delivery.waterways(lines, tags).select("id", "flow")


def _merc(v: str) -> str:
    return f"(0.5 - ln((1 + sin(radians({v}))) / (1 - sin(radians({v})))) / (4 * pi()))"


@query("x03_coverage", f"select area_id, cast(round((least(east, -100) - greatest(west, -115)) / 360 * ({_merc('greatest(south, 30)')} - {_merc('least(north, 45)')}) * 1e10) as bigint) as a from areas where least(east, -100) > greatest(west, -115) and least(north, 45) > greatest(south, 30)")
def _(spark, sf):
    a = _areas(spark, sf).withColumn("k", g("Clip", c("shape"), box(F.lit(-115.0), F.lit(30.0), F.lit(-100.0), F.lit(45.0)), 0.0, 0.0, "polygon"))
    return a.filter("k is not null").select("area_id", _round(g("Area", g("Project", c("k"))), 1e10).alias("a"))


@query("x04_unprojected", "select area_id, cast(round((east - west) * (north - south) * 1e6) as bigint) as a from areas")
def _(spark, sf):
    return _areas(spark, sf).select("area_id", _round(g("Area", g("Unproject", g("Project", c("shape")))), 1e6).alias("a"))


@query("x27_projected", f"select area_id, cast(round((east - west) / 360 * ({_merc('south')} - {_merc('north')}) / 2 * 1e10) as bigint) as a from areas where false union all select area_id, cast(round((east - west) / 360 * ({_merc('south')} - {_merc('north')}) * 1e10) as bigint) from areas")
def _(spark, sf):
    return _areas(spark, sf).select("area_id", _round(g("Area", g("RepairArea", g("Project", c("shape")))), 1e10).alias("a"))


@query("x26_polygons", "select kind, count(*) as parts from areas group by 1")
def _(spark, sf):
    """Parts of each kind's areas, set side by side in one shape; apart by a thousand degrees each, they never touch."""
    a = _areas(spark, sf)
    move = F.array(*(x.cast("double") for x in (F.lit(1), F.lit(0), c("area_id") * 1000, F.lit(0), F.lit(1), F.lit(0))))
    many = a.groupBy("kind").agg(g("Union", F.collect_list(g("Affine", c("shape"), move))).alias("shape"))
    return many.withColumn("part", F.explode(g("Polygons", c("shape")))).groupBy("kind").agg(F.count("*").alias("parts"))


@query("snk02_rings", "with r as (select area_id, cast(round_even(west * 20, 0) as bigint) as x0, cast(round_even(east * 20, 0) as bigint) as x1, cast(round_even(south * 20, 0) as bigint) as y0, cast(round_even(north * 20, 0) as bigint) as y1 from areas) select area_id, (x1 - x0) * (y1 - y0) as a from r where x1 > x0 and y1 > y0")
def _(spark, sf):
    twenty = F.array(*(F.lit(v) for v in (20.0, 0.0, 0.0, 0.0, 20.0, 0.0)))
    a = _areas(spark, sf).withColumn("r", g("RoundOrient", g("Affine", c("shape"), twenty)))
    return a.select("area_id", g("Area", c("r")).cast("bigint").alias("a")).filter("a > 0")


@query("g16_map_network", "select p_partkey, 'osm-' || z || '-' || x || '-' || y || '-' || p_partkey as id, cast(floor((x + p_partkey % 4096 / 4096.0) / (2 ** z) * 1e9 + 0.5) as bigint) as west from (select p_partkey, 13 + p_partkey % 2 as z, p_partkey % 8192 as x, p_partkey % 100 as y from part)")
def _(spark, sf):
    register(spark)
    at = c("p_partkey") % 4096
    text = F.format_string("LINESTRING(%s 0, %s 10)", at.cast("string"), (at + 1).cast("string"))
    f = table(spark, sf, "part").select("p_partkey", (13 + c("p_partkey") % 2).alias("z"), (c("p_partkey") % 8192).alias("x"), (c("p_partkey") % 100).alias("y"), c("p_partkey").alias("id"), F.lit("").alias("name"), g("FromText", text).alias("shape"))
    west = F.regexp_extract(g("AsText", c("shape")), r"\(([0-9.Ee-]+) ", 1).cast("double")
    return network.map_network(f).select(F.split_part("id", F.lit("-"), F.lit(5)).cast("bigint").alias("p_partkey"), "id", F.floor(west * 1e9 + 0.5).cast("bigint").alias("west"))


@query("g17_metres", f"select id, x1 - x0 as there from (select distinct id, x0, x1 from ({_SEG}))")
def _(spark, sf):
    """Lengths of lines put from metres on a tile into the world and back."""
    s = _seg(spark, sf).select("id", "x0", "x1", "shape").distinct()
    z, x, y = F.lit(14), F.lit(2700), F.lit(6200)
    back = network.to_metres(network.to_world(c("shape"), z, x, y), z, x, y)
    return s.select("id", _round(g("Length", back), 1).alias("there"))


def _world_lines(spark, sf):
    """Level lines as a tile's: the map's as references, agencies' as additions half a row away, in world coordinates of one tile a row."""
    s = _seg(spark, sf)
    agency = F.when(c("a") == 0, "OpenStreetMap").when(c("a") == 1, "NPS").otherwise("USFS")
    none = F.lit(None).cast("string")
    z, x, y = F.lit(14), (2000 + F.floor(c("y") / 100)), F.lit(6200)
    low = g("Affine", c("shape"), F.array(*(v.cast("double") for v in (F.lit(0.2), F.lit(0), F.lit(50), F.lit(0), F.lit(0.2), 500 - F.floor(c("y") / 100) * 20 + F.when(c("a") == 0, 0).otherwise(300)))))
    return s.select(
        z.alias("z"), x.alias("x"), y.alias("y"), agency.alias("source"), c("id").cast("string").alias("id"), agency.alias("agency"), F.concat(F.lit("Trail "), c("l_partkey") % 8).alias("name"),
        F.lit("path").alias("class"), F.lit("trail").alias("kind"), none.alias("route_ref"), none.alias("ref"), none.alias("surface"), F.lit(False).alias("bridge"), F.lit(False).alias("tunnel"),
        (c("a") == 0).alias("reference"), network.to_world(low, z, x, y).alias("shape"),
    )


@query("c10_compose", f"select cast(2000 + y // 100 as bigint) as x, cast(round(sum(x1 - x0) * 0.2) as bigint) as length from ({_SEG}) where a = 0 group by 1")
def _(spark, sf):
    """Metres of the map's lines in each composed tile: references are kept whole, whatever is added."""
    out = network.compose(_world_lines(spark, sf)).filter("layer = 'network' and agency = 'OpenStreetMap'")
    back = network.to_metres(c("shape"), c("z"), c("x"), c("y"))
    return out.groupBy(c("x").cast("bigint").alias("x")).agg(F.round(F.sum(g("Length", back))).cast("bigint").alias("length"))


@query("q02_invariance", f"select cast(y // 100 as bigint) as cell, count(distinct id) as ids, 0 as changed from ({_SEG}) where a = 0 group by 1")
def _(spark, sf):
    """The map's lines after conflation against those before, by cell: those more than half a unit off, either way."""
    s = _seg(spark, sf).withColumn("cell", F.floor(c("y") / 100))
    agency, none = F.when(c("a") == 0, "OpenStreetMap").when(c("a") == 1, "NPS").otherwise("USFS"), F.lit(None).cast("string")
    lines = s.select(
        "cell", c("id").cast("string").alias("id"), agency.alias("agency"), F.concat(F.lit("Trail "), c("l_partkey") % 8).alias("name"), F.lit("path").alias("class"), F.lit("trail").alias("kind"),
        none.alias("route_ref"), none.alias("ref"), none.alias("surface"), F.lit(False).alias("bridge"), F.lit(False).alias("tunnel"), (c("a") == 0).alias("reference"), "shape",
    )
    union = lambda df, name: df.groupBy("cell", "id").agg(g("Union", F.collect_set("shape")).alias(name))
    after = union(shapes.conflate(lines, ["cell"], [c("agency"), c("id")]).filter("agency = 'OpenStreetMap'"), "after")
    before = union(lines.filter("reference"), "before")
    both = before.join(after, ["cell", "id"], "full")
    off = F.greatest(g("Hausdorff", c("before"), c("after")), g("Hausdorff", c("after"), c("before")))
    return both.groupBy("cell").agg(F.count("before").alias("ids"), F.count_if(F.coalesce(off > 0.5**0.5, F.lit(True))).cast("int").alias("changed"))


@query("pc02_developed", "select p_partkey, p_partkey % 5 < 2 as developed from part")
def _(spark, sf):
    """Places in a row 1,000 m apart; the first two of five have three houses of 300 square metres within 70 m, one has two, one has them far off, one has sheds."""
    p = table(spark, sf, "part").select("p_partkey", (c("p_partkey") % 100 * 1000.0).alias("x"), (F.floor(c("p_partkey") / 100) * 1000.0).alias("y"), (c("p_partkey") % 5).alias("k"))
    count, off = F.when(c("k") == 2, 2).otherwise(3), F.when(c("k") == 3, 100.0).otherwise(20.0)
    side = F.when(c("k") == 4, 4.0).otherwise(17.5)
    b = p.withColumn("i", F.explode(F.sequence(F.lit(1), count)))
    west, south = c("x") + off + (c("i") - 1) * 19, c("y") + off
    register(spark)
    b = b.select(box(west, south, west + side, south + side).alias("shape"))
    return network.developed(p.select("p_partkey", "x", "y"), b, "p_partkey").select("p_partkey", "developed")
