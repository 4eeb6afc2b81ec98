"""Queries of aggregations, ledgers, orders, sets, audits and rasters, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.names import plain_name
from ..operators import audit, ledger, lines, raster
from ..operators.classify import lookup
from ..session import small, table
from .registry import query

_STATUS = {"F": "done", "O": "pending", "P": "working"}


def _tasks(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("key"), lookup(F.col("o_orderstatus"), _STATUS).alias("status"), F.substring("o_orderpriority", 3, 20).alias("source"),
        F.floor("o_totalprice").cast("bigint").alias("size"), (F.col("o_orderkey") % 6).cast("int").alias("attempts"), F.col("o_orderdate").alias("ts"), "o_custkey",
    )


_TASKS = "select o_orderkey as key, case o_orderstatus when 'F' then 'done' when 'O' then 'pending' when 'P' then 'working' end as status, substr(o_orderpriority, 3, 20) as source, cast(floor(o_totalprice) as bigint) as size, cast(o_orderkey % 6 as int) as attempts, o_orderdate as ts, o_custkey from orders"


@query("agg02_layer_counts", "select kind as layer, count(*) as n from features group by 1")
def _(spark, sf):
    return table(spark, sf, "features").groupBy(F.col("kind").alias("layer")).agg(F.count("*").alias("n"))


@query("agg04_water_labels", "select lower(trim(name)) as k, min(min_zoom) as min_zoom, coalesce(max(case when kind <> 'spring' then kind end), 'spring') as class from features where name is not null group by 1")
def _(spark, sf):
    f = table(spark, sf, "features").filter("name is not null")
    best = F.coalesce(F.max(F.when(F.col("kind") != "spring", F.col("kind"))), F.lit("spring"))
    return f.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("min_zoom").alias("min_zoom"), best.alias("class"))


@query("agg05_latest_edition", "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as latest from orders group by 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("agg06_unique_sources", "select id, max(ingested_at) as last from features group by 1")
def _(spark, sf):
    return table(spark, sf, "features").groupBy("id").agg(F.max("ingested_at").alias("last"))


_RECORDS = "array<struct<id string, agency string, name string, details map<string, string>>>"


@query("agg07_provenance", """with e as (select distinct match_group, json_extract_string(r, '$.id') as rid, json_extract_string(r, '$.agency') as agency from
  (select match_group, unnest(cast(json_extract(case when json_valid(source_records) then source_records end, '$[*]') as json[])) as r from features where match_group is not null))
  select match_group, count(distinct rid) as n, array_to_string(list_sort(list(distinct rid)), ',') as ids from e group by 1""")
def _(spark, sf):
    e = table(spark, sf, "features").filter("match_group is not null").select("match_group", F.explode(F.from_json("source_records", _RECORDS)).alias("r"))
    e = e.select("match_group", "r.id").distinct()
    return e.groupBy("match_group").agg(F.count("id").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


@query("agg08_record_merge", """with e as (select match_group, json_extract_string(r, '$.agency') as agency, json_extract_string(r, '$.id') as rid, id as via from
  (select match_group, id, unnest(cast(json_extract(case when json_valid(source_records) then source_records end, '$[*]') as json[])) as r from features where match_group is not null))
  select match_group, agency, rid, max(via) as via from e group by 1, 2, 3""")
def _(spark, sf):
    e = table(spark, sf, "features").filter("match_group is not null").select("match_group", "id", F.explode(F.from_json("source_records", _RECORDS)).alias("r"))
    return e.groupBy("match_group", F.col("r.agency").alias("agency"), F.col("r.id").alias("rid")).agg(F.max("id").alias("via"))


@query("agg09_group_icons", "select unit, count(*) as members, array_to_string(list_sort(list(distinct kind)), ',') as icons from facilities where unit <> '' group by 1")
def _(spark, sf):
    f = table(spark, sf, "facilities").filter("unit <> ''")
    return f.groupBy("unit").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("icons"))


@query("agg10_site_only", "select a.unit, array_to_string(list_sort([k for k in a.ks if not list_contains(coalesce(b.ks, []), k)]), ',') as only from (select unit, list(distinct kind) as ks from facilities where unit <> '' group by 1) a left join (select unit, list(distinct kind) as ks from features where unit <> '' group by 1) b using (unit)")
def _(spark, sf):
    kinds = lambda t, c: table(spark, sf, t).filter("unit <> ''").groupBy("unit").agg(F.collect_set("kind").alias(c))
    j = kinds("facilities", "a").join(kinds("features", "b"), "unit", "left")
    return j.select("unit", F.array_join(F.array_sort(F.array_except("a", F.coalesce("b", F.array().cast("array<string>")))), ",").alias("only"))


@query("agg11_import_counters", "select agency, kind, state_name, count(*) as n, count(feature_id) as with_id from landmarks group by grouping sets ((agency, kind), (agency, state_name), ())")
def _(spark, sf):
    table(spark, sf, "landmarks").createOrReplaceTempView("_scoria_landmarks")
    return spark.sql("select agency, kind, state_name, count(*) as n, count(feature_id) as with_id from _scoria_landmarks group by grouping sets ((agency, kind), (agency, state_name), ())")


@query("agg12_rank_summary", "select kind, min_zoom, count(*) as n, count(*) filter (elevation_m between -500 and 9000) as known from landmarks group by grouping sets ((kind), (min_zoom))")
def _(spark, sf):
    l = table(spark, sf, "landmarks")  # noqa: E741
    known = F.count_if(F.col("elevation_m").between(-500, 9000)).alias("known")
    out = [l.groupBy(c).agg(F.count("*").alias("n"), known) for c in ("kind", "min_zoom")]
    return out[0].unionByName(out[1], allowMissingColumns=True)


@query("agg13_status", f"with t as ({_TASKS}) select source, status, count(*) as n, cast(sum(size) as bigint) as bytes from t group by rollup(source, status)")
def _(spark, sf):
    return _tasks(spark, sf).rollup("source", "status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("agg14_upload_totals", f"with t as ({_TASKS}) select count(*) filter (status = 'done') as done, cast(coalesce(sum(size) filter (status = 'done'), 0) as bigint) as bytes from t")
def _(spark, sf):
    d = F.col("status") == "done"
    return _tasks(spark, sf).agg(F.count_if(d).alias("done"), F.coalesce(F.sum(F.when(d, F.col("size"))), F.lit(0)).alias("bytes"))


@query("agg15_stage_timing", f"with t as ({_TASKS}) select source, count(*) as n, cast(sum(size) as bigint) as total, max(size) as longest from t group by 1")
def _(spark, sf):
    return _tasks(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max("size").alias("longest"))


@query("agg16_monthly_usage", f"with t as ({_TASKS}) select strftime(ts, '%Y-%m') as month, status as role, cast(sum(size) as bigint) as used from t group by 1, 2")
def _(spark, sf):
    return _tasks(spark, sf).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.col("status").alias("role")).agg(F.sum("size").alias("used"))


@query("agg17_street_mass", "with s as (select (l_partkey % 500) * 10 as x0, 5 + l_quantity as steps, (l_orderkey % 200) as y from lineitem) select cast(x as bigint) as x, y, count(*) as mass from (select y, unnest(range(cast(x0 as bigint), cast(x0 + steps as bigint))) as x from s) group by 1, 2")
def _(spark, sf):
    s = table(spark, sf, "lineitem").select(((F.col("l_partkey") % 500) * 10).alias("x0"), (5 + F.col("l_quantity")).cast("bigint").alias("steps"), (F.col("l_orderkey") % 200).alias("y"))
    return ledger.mass(s, "y", "x0", "steps", "x")


@query("agg18_developed", "with p as (select (o_custkey % 400) as x, (o_orderkey % 300) as y, 20 + o_orderkey % 30 as a from orders) select x, y, count(*) as parts, sum(a) as area, count(*) filter (a >= 25) >= 3 and sum(a) >= 100 as developed from p group by 1, 2")
def _(spark, sf):
    p = table(spark, sf, "orders").select((F.col("o_custkey") % 400).alias("x"), (F.col("o_orderkey") % 300).alias("y"), (20 + F.col("o_orderkey") % 30).alias("a"))
    return p.groupBy("x", "y").agg(F.count("*").alias("parts"), F.sum("a").alias("area"), ((F.count_if(F.col("a") >= 25) >= 3) & (F.sum("a") >= 100)).alias("developed"))


@query("agg21_percentiles", "select l_suppkey % 50 as k, cast(floor(quantile_cont(l_quantity, 0.5) * 100) as bigint) as p50, cast(floor(quantile_cont(l_quantity, 0.9) * 100) as bigint) as p90 from lineitem group by 1")
def _(spark, sf):
    p = lambda q: F.floor(F.percentile("l_quantity", F.lit(q)) * 100)
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("k")).agg(p(0.5).alias("p50"), p(0.9).alias("p90"))


_DEM = "select vec_id as id, cast((i - 1) // 8 as int) as r, cast((i - 1) % 8 as int) as c, cast(floor(cast(embedding[i] as double) * 1000 + 0.5) as bigint) as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)"


def _dem(spark, sf):
    return raster.long_form(table(spark, sf, "embeddings"), "vec_id", "embedding", 8)


def _top(spark, sf, name, key):
    """Largest key of a table and one; 1 if it is empty."""
    return (table(spark, sf, name).agg(F.max(key)).first()[0] or 0) + 1


@query("agg23_pixel_counts", f"with d as ({_DEM}) select id, count(*) as expected, count(*) filter (v > 0) as valid, sha256(string_agg(cast(v as varchar), ',' order by r, c)) as digest from d group by 1")
def _(spark, sf):
    d = _dem(spark, sf).groupBy("id").agg(F.count("*").alias("expected"), F.count_if(F.col("v") > 0).alias("valid"), F.array_sort(F.collect_list(F.struct("r", "c", "v"))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: x["v"].cast("string")), ",")
    return d.select("id", "expected", "valid", F.sha2(text, 256).alias("digest"))


@query("agg24_source_hash", "select n_regionkey, sha256(string_agg(sha256(n_name), '' order by sha256(n_name))) as h from nation group by 1")
def _(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.sha2("n_name", 256))).alias("a"))
    return n.select("n_regionkey", F.sha2(F.array_join("a", ""), 256).alias("h"))


@query("agg28_conflict_summary", "select kind, count(distinct match_group) as groups, count(distinct agency) as agencies from features where match_group is not null group by 1")
def _(spark, sf):
    return table(spark, sf, "features").filter("match_group is not null").groupBy("kind").agg(F.countDistinct("match_group").alias("groups"), F.countDistinct("agency").alias("agencies"))


@query("so02_work_queue", f"with t as ({_TASKS}) select key, source from t where status = 'pending' and source = (select max(source) from t where status = 'pending') order by key limit 8")
def _(spark, sf):
    p = _tasks(spark, sf).filter("status = 'pending'")
    return p.orderBy(F.col("source").desc(), "key").limit(8).select("key", "source")


@query("so03_retry_due", f"with t as ({_TASKS}) select key, attempts from t where status = 'pending' and attempts > 2 order by attempts, key limit 32")
def _(spark, sf):
    return _tasks(spark, sf).filter("status = 'pending' and attempts > 2").orderBy("attempts", "key").limit(32).select("key", "attempts")


@query("so04_evict", f"with t as ({_TASKS}), r as (select *, sum(size) over (partition by source) - 20000000 as excess, coalesce(sum(size) over (partition by source order by ts, key rows between unbounded preceding and 1 preceding), 0) as before from t) select key, source from r where before < excess")
def _(spark, sf):
    return ledger.evict(_tasks(spark, sf), 20_000_000, ["ts", "key"], "source").select("key", "source")


@query("so05_plan_order", "select area_id, case kind when 'park' then 0 when 'forest' then 1 else 2 end as rank from areas")
def _(spark, sf):
    r = F.when(F.col("kind") == "park", 0).when(F.col("kind") == "forest", 1).otherwise(2)
    return table(spark, sf, "areas").select("area_id", r.alias("rank")).orderBy("rank", "area_id")


@query("so06_amenity_order", "select distinct osm_id, tags['operator'] is null as loose, tags['name'] is null as unnamed from osm_elements")
def _(spark, sf):
    t = F.col("tags")
    return table(spark, sf, "osm_elements").select("osm_id", t["operator"].isNull().alias("loose"), t["name"].isNull().alias("unnamed")).distinct().orderBy("loose", "unnamed", "osm_id")


@query("so08_caps", "select o_custkey, array_to_string(list_slice(list_sort(list(o_orderkey)), 1, 12), ',') as keys from orders group by 1")
def _(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")  # the first twelve only: a group limit, not a whole list
    o = table(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 12")
    return o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("keys"))


@query("so09_newest_first", "with r as (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) select event_id, user_id, rn from r where rn <= 5")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id")
    return table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("event_id", "user_id", "rn")


@query("set01_union", "select id, kind, agency from facilities union all select id, kind, agency from features union all select id, kind, agency from landmarks")
def _(spark, sf):
    f, g, h = (table(spark, sf, t).select("id", "kind", "agency") for t in ("facilities", "features", "landmarks"))
    return f.unionByName(g).unionByName(h)


@query("set06_shared", "select p_partkey, len(list_intersect([p_partkey % 5, p_partkey % 7], [p_size % 5, p_size % 7])) > 0 as shared from part")
def _(spark, sf):
    c = F.col
    return table(spark, sf, "part").select("p_partkey", F.arrays_overlap(F.array(c("p_partkey") % 5, c("p_partkey") % 7), F.array((c("p_size") % 5).cast("bigint"), (c("p_size") % 7).cast("bigint"))).alias("shared"))


@query("set08_composition_diff", f"with t as ({_TASKS}), a as (select source, count(*) as n from t where o_custkey % 2 = 0 group by 1), b as (select source, count(*) as n from t where o_custkey % 3 = 0 group by 1) select coalesce(a.source, b.source) as source, a.n as before, b.n as after, a.n is distinct from b.n as changed from a full join b on a.source = b.source")
def _(spark, sf):
    t = _tasks(spark, sf)
    count = lambda k, name: t.filter(F.col("o_custkey") % k == 0).groupBy("source").agg(F.count("*").alias(name))
    return count(2, "before").join(count(3, "after"), "source", "full").withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


@query("set09_newest_wins", "select user_id, max(ts) as ts, arg_max(event_type, (ts, event_id)) as kind from events group by 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))


@query("f17_backoff", f"with t as ({_TASKS}) select key, cast(least(3600, 30 * pow(2, least(attempts, 7))) as double) as a, cast(least(300, 5 * pow(2, least(attempts, 30))) as double) as b from t")
def _(spark, sf):
    n = F.col("attempts")
    return _tasks(spark, sf).select("key", ledger.backoff(n).alias("a"), ledger.backoff(n, 5, 300, 30).alias("b"))


@query("l03_journal", f"""with t as ({_TASKS}), s as (select key, attempts, 1000.0 as retry_at from t where attempts > 0), b as (select key, status = 'done' as ok from t where o_custkey % 4 = 0),
  j as (select coalesce(s.key, b.key) as key, b.ok, s.attempts, s.retry_at from s full join b on s.key = b.key), u as (select *, case when ok is null then attempts else coalesce(attempts, 0) + 1 end as tries from j where ok is null or not ok)
  select key, tries as attempts, cast(case when ok is null then retry_at else 5000 + least(3600, 30 * pow(2, least(tries, 7))) end as bigint) as retry_at from u""")
def _(spark, sf):
    t = _tasks(spark, sf)
    s = t.filter("attempts > 0").select("key", "attempts", F.lit(1000.0).alias("retry_at"))
    b = t.filter("o_custkey % 4 = 0").select("key", (F.col("status") == "done").alias("ok"))
    return ledger.record(s, b, F.lit(5000.0)).select("key", "attempts", F.col("retry_at").cast("bigint").alias("retry_at"))


@query("l04_run_identity", "select o_orderstatus, sha256('{\"source\":\"' || o_orderstatus || '\",\"zoom\":' || count(*) || '}') as run from orders group by 1")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return o.select("o_orderstatus", F.sha2(F.to_json(F.struct(F.col("o_orderstatus").alias("source"), F.col("n").alias("zoom"))), 256).alias("run"))


@query("l05_task_states", f"""with t as ({_TASKS}), r as (select key, o_custkey % 3 > 0 as ok, size as bytes from t where status = 'working')
  select t.key, case when r.ok then 'done' when not r.ok then case when attempts + 1 >= 5 then 'error' else 'pending' end else status end as status, case when not r.ok then attempts + 1 else attempts end as attempts, coalesce(r.bytes * (r.ok::int), 0) as bytes from t left join r on t.key = r.key""")
def _(spark, sf):
    t = _tasks(spark, sf).withColumn("retry_at", F.lit(0.0)).withColumn("bytes", F.lit(0).cast("bigint"))
    r = t.filter("status = 'working'").select("key", (F.col("o_custkey") % 3 > 0).alias("ok"), F.col("size").alias("bytes"))
    return ledger.finish(t, r, F.lit(0.0)).select("key", "status", "attempts", "bytes")


@query("l06_immutable_puts", f"with t as (select source || (o_custkey % 50) as key, size from ({_TASKS})) select key, count(distinct sha256(cast(size as varchar))) as hashes from t group by 1 having count(distinct size) > 1")
def _(spark, sf):
    t = _tasks(spark, sf).select(F.concat("source", (F.col("o_custkey") % 50)).alias("key"), "size", F.sha2(F.col("size").cast("string"), 256).alias("sha"))
    return ledger.conflicts(t).select("key", "hashes")


@query("l07_reservations", f"with t as ({_TASKS}) select key, source, cast(sum(size) over (partition by source order by ts, key) as bigint) as held, sum(size) over (partition by source order by ts, key) <= 100000000 as fits from t")
def _(spark, sf):
    w = Window.partitionBy("source").orderBy("ts", "key").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum("size").over(w)
    return _tasks(spark, sf).select("key", "source", held.alias("held"), (held <= 100_000_000).alias("fits"))


@query("l08_reconcile", f"with t as ({_TASKS}) select key, max(size) as size from (select key, size from t where status = 'done' union all select key, size from t where o_custkey % 2 = 0) group by 1")
def _(spark, sf):
    t = _tasks(spark, sf)
    return t.filter("status = 'done'").select("key", "size").union(t.filter("o_custkey % 2 = 0").select("key", "size")).groupBy("key").agg(F.max("size").alias("size"))


@query("l09_shard_resume", f"with t as ({_TASKS}) select o_custkey % 100 as shard, count(*) as left from t where o_custkey % 100 not in (select o_custkey % 100 from t group by 1 having bool_and(status = 'done')) group by 1")
def _(spark, sf):
    t = _tasks(spark, sf).withColumn("shard", F.col("o_custkey") % 100)
    done = t.groupBy("shard").agg(F.bool_and(F.col("status") == "done").alias("d")).filter("d").select("shard")
    return t.join(done, "shard", "left_anti").groupBy("shard").agg(F.count("*").alias("left"))


@query("l11_upgrade", "with a as (select kind as t, min(area_id) as z0, max(area_id) as z1 from areas where area_id % 2 = 0 group by 1), b as (select kind as t, min(area_id) as z0, max(area_id) as z1 from areas group by 1) select a.t, b.t is not null and b.z0 <= a.z0 and b.z1 >= a.z1 as ok from a left join b on a.t = b.t")
def _(spark, sf):
    spec = lambda df: df.groupBy(F.col("kind").alias("t")).agg(F.min("area_id").alias("z0"), F.max("area_id").alias("z1"))
    a = table(spark, sf, "areas")
    old, new = spec(a.filter("area_id % 2 = 0")).alias("a"), spec(a).alias("b")
    ok = F.col("b.t").isNotNull() & (F.col("b.z0") <= F.col("a.z0")) & (F.col("b.z1") >= F.col("a.z1"))
    return old.join(new, F.col("a.t") == F.col("b.t"), "left").select("a.t", ok.alias("ok"))


@query("st06_rate_limit", "select event_id, row_number() over (partition by event_type, date_trunc('minute', ts) order by ts, event_id) <= 3 as allowed from events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("role"), "ts")
    return ledger.minute_limited(e, 3).select(F.col("id").alias("event_id"), "allowed")


@query("st07_monthly_quota", """with recursive e as (select event_type || strftime(ts, '%Y-%m') as k, event_id, cast(floor(value) as bigint) as a, row_number() over (partition by event_type || strftime(ts, '%Y-%m') order by ts, event_id) as rn from events),
  f as (select k, event_id, a, rn, a <= 500 as ok, case when a <= 500 then a else 0 end as used from e where rn = 1 union all
  select e.k, e.event_id, e.a, e.rn, f.used + e.a <= 500, case when f.used + e.a <= 500 then f.used + e.a else f.used end from f join e on e.k = f.k and e.rn = f.rn + 1)
  select event_id, ok as allowed from f""")
def _(spark, sf):
    from ..streaming.quota import charge

    e = table(spark, sf, "events")
    e = e.select("event_id", F.concat("event_type", F.date_format("ts", "yyyy-MM")).alias("k"), "ts", F.floor("value").cast("bigint").alias("amount"))
    return charge(e, ["k"], 500).select("event_id", "allowed")


@query("st12_finished_prefix", f"with t as ({_TASKS}) select source, coalesce(min(case when status <> 'done' then key end) - 1, max(key)) as upto from t group by 1")
def _(spark, sf):
    return ledger.finished_prefix(_tasks(spark, sf), ["source"], "key")


@query("st14_retry_queue", f"with t as ({_TASKS}) select key, cast(least(300000, 30000 * pow(2, attempts)) as bigint) as due from t where status = 'pending' and attempts <= 3")
def _(spark, sf):
    t = _tasks(spark, sf).filter("status = 'pending' and attempts <= 3")
    return t.select("key", ledger.backoff(F.col("attempts"), 30_000, 300_000, 30).cast("bigint").alias("due"))


@query("j27_endpoints", "with e as (select l_orderkey * 10 + l_linenumber as id, (l_partkey % 500) * 10 as x, l_orderkey % 200 as y from lineitem union all select l_orderkey * 10 + l_linenumber, (l_partkey % 500) * 10 + 50 + cast(l_quantity as bigint) * 5, l_orderkey % 200 from lineitem) select x, y, count(distinct id) as lines, count(*) as ends from e group by 1, 2 having count(distinct id) > 1")
def _(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    i, x, y = F.col("l_orderkey") * 10 + F.col("l_linenumber"), (F.col("l_partkey") % 500) * 10, F.col("l_orderkey") % 200
    e = l.select(i.alias("id"), F.explode(F.array(x, x + 50 + F.col("l_quantity").cast("bigint") * 5)).alias("x"), y.alias("y"))
    return e.groupBy("x", "y").agg(F.countDistinct("id").alias("lines"), F.count("*").alias("ends")).filter("lines > 1")


@query("j28_completeness", "select a.unit, len([k for k in a.ks if not list_contains(coalesce(b.ks, []), k)]) as missing from (select unit, list(distinct kind) as ks from features where unit <> '' group by 1) a left join (select unit, list(distinct kind) as ks from facilities where unit <> '' group by 1) b using (unit)")
def _(spark, sf):
    kinds = lambda t, c: table(spark, sf, t).filter("unit <> ''").groupBy("unit").agg(F.collect_set("kind").alias(c))
    j = kinds("features", "a").join(kinds("facilities", "b"), "unit", "left")
    return j.select("unit", F.size(F.array_except("a", F.coalesce("b", F.array().cast("array<string>")))).alias("missing"))


@query("j30_coverage", f"with t as ({_TASKS}) select key from t where o_custkey % 5 = 0 and key not in (select key from t where status = 'done')")
def _(spark, sf):
    t = _tasks(spark, sf)
    return t.filter("o_custkey % 5 = 0").select("key").join(t.filter("status = 'done'").select("key"), "key", "left_anti")


@query("j31_cell_audit", f"with d as ({_DEM}) select p_partkey, v from part left join d on d.id = p_partkey % (select max(vec_id) + 1 from embeddings) and d.r = p_partkey % 8 and d.c = p_size % 8")
def _(spark, sf):
    # Labels lie on all blocks; one on a block that is missing stays, without a value.
    i = F.col("p_partkey") % _top(spark, sf, "embeddings", "vec_id")
    p = table(spark, sf, "part").select("p_partkey", i.alias("id"), (F.col("p_partkey") % 8).cast("int").alias("r"), (F.col("p_size") % 8).alias("c"))
    return p.join(_dem(spark, sf), ["id", "r", "c"], "left").select("p_partkey", "v")


@query("q05_recommend", """with m as (select l_orderkey, l_linenumber, l_discount * 20 as cov, l_quantity * 10 as novel, l_extendedprice / 500 as p90, l_suppkey % 4 = 0 as loose, 1 - l_tax * 2 as same, 1 + l_discount * 4 as ratio, l_linenumber * 0.5 as denser, l_partkey % 6 as turns from lineitem)
  select l_orderkey, l_linenumber, case when cov < 0.65 then 'uncertain' when novel > 200 and (p90 > 75 or loose) then 'partial' when same > 0.9 and ratio < 1.08 or denser >= 1.7 and ratio < 1.3 and turns <= 3 then 'prefer' else 'uncertain' end as choice from m""")
def _(spark, sf):
    c = F.col
    choice = audit.recommend(
        c("l_discount") * 20, c("l_quantity") * 10, c("l_extendedprice") / 500, c("l_suppkey") % 4 == 0, 1 - c("l_tax") * 2, 1 + c("l_discount") * 4, c("l_linenumber") * 0.5, c("l_partkey") % 6
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", choice.alias("choice"))


@query("q08_case_ids", "select distinct match_group, substr(sha256(match_group || ':' || kind), 1, 20) as case_id from features where match_group is not null")
def _(spark, sf):
    f = table(spark, sf, "features").filter("match_group is not null").select("match_group", "kind").distinct()
    return f.select("match_group", F.substring(F.sha2(F.concat_ws(":", "match_group", "kind"), 256), 1, 20).alias("case_id")).distinct()


@query("q11_equivalence", "select count(*) as differing from (select id, kind from features except all select id, kind from (select id, kind, row_number() over (order by id, kind) as rn from features))")
def _(spark, sf):
    """Rows of each id and kind, counted by an aggregate and by a window; compared both ways."""
    f = table(spark, sf, "features").select("id", "kind")
    counted = f.withColumn("n", F.count("*").over(Window.partitionBy("id", "kind"))).distinct()
    return ledger.differing(f.groupBy("id", "kind").agg(F.count("*").alias("n")), counted)


@query("q12_forecast", f"with t as ({_TASKS}) select source, cast(ceil(count(*) filter (status <> 'done') * 1000.0 / count(*) filter (status = 'done')) as bigint) as left1000 from t group by 1")
def _(spark, sf):
    t = _tasks(spark, sf).groupBy("source").agg(F.count_if(F.col("status") != "done").alias("a"), F.count_if(F.col("status") == "done").alias("b"))
    return t.select("source", F.ceil(F.col("a") * 1000.0 / F.col("b")).cast("bigint").alias("left1000"))


@query("r01_gap_fill", f"with d as ({_DEM}) select id, count(*) filter (v > 100) as fine, count(*) filter (v <= 100 and v > -100) as coarse, count(*) filter (v <= -100) as none, cast(sum(case when v > 100 then v when v > -100 then v * 2 else 0 end) as bigint) as total from d group by 1")
def _(spark, sf):
    v = F.col("v")
    fine, coarse = F.when(v > 100, v), F.when((v <= 100) & (v > -100), v * 2)
    d = _dem(spark, sf).select("id", fine.alias("f"), coarse.alias("c"), F.coalesce(fine, coarse, F.lit(0)).alias("h"))
    none = F.count_if(F.col("f").isNull() & F.col("c").isNull())
    return d.groupBy("id").agg(F.count("f").alias("fine"), F.count("c").alias("coarse"), none.alias("none"), F.sum("h").alias("total"))


@query("r02_chunks", "select p_partkey, p_partkey // 1024 as cx, cast(least(1024, (select greatest(2500, max(p_partkey) + 1) from part) - (p_partkey // 1024) * 1024) as bigint) as width from part")
def _(spark, sf):
    # The grid is 2500 wide, or as wide as its keys need.
    cx, wide = F.floor(F.col("p_partkey") / 1024), max(2500, _top(spark, sf, "part", "p_partkey"))
    return table(spark, sf, "part").select("p_partkey", cx.alias("cx"), F.least(F.lit(1024), wide - cx * 1024).cast("bigint").alias("width"))


@query("r03_window_chunks", "with w as (select p_partkey, p_partkey * 37 as x0, p_partkey * 53 as y0 from part) select p_partkey, cx, cy from (select p_partkey, cx, unnest(range(cast(floor((y0 - 2) / 1024.0) as bigint), cast(floor((y0 + 258 + 1) / 1024.0) as bigint) + 1)) as cy from (select *, unnest(range(cast(floor((x0 - 2) / 1024.0) as bigint), cast(floor((x0 + 258 + 1) / 1024.0) as bigint) + 1)) as cx from w))")
def _(spark, sf):
    x, y = F.col("p_partkey") * 37, F.col("p_partkey") * 53
    k = F.explode(raster.chunk_keys(x, x + 258, y, y + 258)).alias("k")
    return table(spark, sf, "part").select("p_partkey", k).select("p_partkey", "k.cx", "k.cy")


@query("r05_contours", f"""with d as ({_DEM}), e as (select a.id, a.r, a.c, 'h' as side, a.v, b.v as w from d a join d b on a.id = b.id and a.r = b.r and b.c = a.c + 1 union all select a.id, a.r, a.c, 'v', a.v, b.v from d a join d b on a.id = b.id and a.c = b.c and b.r = a.r + 1)
  select id, r, c, side, k * 100 as level from (select *, unnest(range(cast(ceil(least(v, w) / 100.0) as bigint), cast(ceil(greatest(v, w) / 100.0) as bigint))) as k from e where v <> w) where k <> 0""")
def _(spark, sf):
    return raster.crossings(_dem(spark, sf), 100)


@query("r06_regional_contours", f"""with d as ({_DEM}), e as (select a.id, a.v, b.v as w from d a join d b on a.id = b.id and a.r = b.r and b.c = a.c + 1 union all select a.id, a.v, b.v from d a join d b on a.id = b.id and a.c = b.c and b.r = a.r + 1)
  select id, k * 100 as level, count(*) as n from (select *, unnest(range(cast(ceil(least(v, w) / 100.0) as bigint), cast(ceil(greatest(v, w) / 100.0) as bigint))) as k from e where v <> w) where k > 0 group by 1, 2""")
def _(spark, sf):
    return raster.crossings(_dem(spark, sf), 100).filter("level > 0").groupBy("id", "level").agg(F.count("*").alias("n"))


@query("r08_index_contours", f"""with d as ({_DEM}), e as (select a.id, a.v, b.v as w from d a join d b on a.id = b.id and a.r = b.r and b.c = a.c + 1 union all select a.id, a.v, b.v from d a join d b on a.id = b.id and a.c = b.c and b.r = a.r + 1)
  select k * 20 as level, k * 20 % 100 = 0 as is_index, count(*) as n from (select *, unnest(range(cast(ceil(least(v, w) / 20.0) as bigint), cast(ceil(greatest(v, w) / 20.0) as bigint))) as k from e where v <> w) where k <> 0 group by 1, 2""")
def _(spark, sf):
    return raster.crossings(_dem(spark, sf), 20).groupBy("level", (F.col("level") % 100 == 0).alias("is_index")).agg(F.count("*").alias("n"))


@query("r07_intervals", "select min_zoom, case when min_zoom >= 14 then 20 when min_zoom >= 13 then 40 when min_zoom >= 12 then 100 else 200 end as minor, count(*) as n from landmarks group by 1, 2")
def _(spark, sf):
    z = F.col("min_zoom")
    minor = F.when(z >= 14, 20).when(z >= 13, 40).when(z >= 12, 100).otherwise(200)
    return table(spark, sf, "landmarks").groupBy("min_zoom", minor.alias("minor")).agg(F.count("*").alias("n"))


@query("r10_child_mosaic", f"with d as ({_DEM}) select id // 4 as parent, cast((id % 4 // 2) * 8 + r as int) as r, cast((id % 2) * 8 + c as int) as c, v from d")
def _(spark, sf):
    i = F.col("id")
    return _dem(spark, sf).select(F.floor(i / 4).alias("parent"), (F.floor(i % 4 / 2) * 8 + F.col("r")).cast("int").alias("r"), (i % 2 * 8 + F.col("c")).cast("int").alias("c"), "v")


@query("r11_bilinear", f"""with d as ({_DEM}) select a.id, cast(floor(a.v * 0.75 * 0.5 + b.v * 0.25 * 0.5 + c.v * 0.75 * 0.5 + d2.v * 0.25 * 0.5) as bigint) as v from d a join d b on b.id = a.id and b.r = a.r and b.c = a.c + 1 join d c on c.id = a.id and c.r = a.r + 1 and c.c = a.c join d d2 on d2.id = a.id and d2.r = a.r + 1 and d2.c = a.c + 1 where a.r = 3 and a.c = 4""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    at = lambda r, c: F.floor(F.get("embedding", F.lit(r * 8 + c)).cast("double") * 1000 + 0.5)
    v = raster.bilinear(at(3, 4), at(3, 5), at(4, 4), at(4, 5), F.lit(0.25), F.lit(0.5))
    return e.select(F.col("vec_id").alias("id"), F.floor(v).alias("v"))


@query("r14_resolution", "select area_id, cast(greatest(16, least(256, ceil((east - west) * 111320 / 30))) as bigint) as px from areas")
def _(spark, sf):
    w = F.ceil((F.col("east") - F.col("west")) * 111320 / 30)
    return table(spark, sf, "areas").select("area_id", F.greatest(F.lit(16), F.least(F.lit(256), w)).cast("bigint").alias("px"))


@query("r15_disk_sum", f"with d as ({_DEM}) select a.id, a.r, a.c, cast(sum(b.v) as bigint) as s from d a join d b on a.id = b.id and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 4 group by 1, 2, 3")
def _(spark, sf):
    return raster.disk_sum(_dem(spark, sf), 2)


@query("r16_box_mask", f"with d as ({_DEM}) select id, count(*) filter (r between 2 and 5 and c between 1 and 6) as inside, count(*) filter (r between 2 and 5 and c between 1 and 6 and v > 0) as valid from d group by 1")
def _(spark, sf):
    inside = F.col("r").between(2, 5) & F.col("c").between(1, 6)
    return _dem(spark, sf).groupBy("id").agg(F.count_if(inside).alias("inside"), F.count_if(inside & (F.col("v") > 0)).alias("valid"))


@query("r17_open_water", f"with d as ({_DEM}) select distinct id from d where id not in (select id from d where v > 250)")
def _(spark, sf):
    d = _dem(spark, sf)
    return d.select("id").distinct().join(d.filter("v > 250").select("id").distinct(), "id", "left_anti")


@query("r18_prefetch", "select distinct x // 8 as cx, y // 8 as cy from (select p_partkey % 500 as x, p_partkey % 7 as y from part) where (x // 8) % 2 = 0")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") % 500 / 8).alias("cx"), F.floor(F.col("p_partkey") % 7 / 8).alias("cy")).distinct()
    cached = p.filter("cx % 2 = 1")
    return p.join(cached, ["cx", "cy"], "left_anti")


@query("snk03_terrarium", f"""with d as ({_DEM}), n as (select id, r, c, cast(round_even(greatest(0, least(v + 0.5 + 32768, 65535.996)) * 256, 0) as bigint) as n from d) select id, r, c, (n >> 16) & 255 as red, (n >> 8) & 255 as green, n & 255 as blue from n""")
def _(spark, sf):
    d = _dem(spark, sf).withColumn("t", raster.terrarium(F.col("v") + 0.5))
    return d.select("id", "r", "c", "t.red", "t.green", "t.blue")


@query("snk04_round_trip", f"with d as ({_DEM}) select id, r, c, cast(v as bigint) as back from d")
def _(spark, sf):
    d = _dem(spark, sf).withColumn("t", raster.terrarium(F.col("v").cast("double")))
    return d.select("id", "r", "c", raster.from_terrarium(F.col("t.red"), F.col("t.green"), F.col("t.blue")).cast("bigint").alias("back"))


@query("snk11_tile_gate", f"with t as ({_TASKS}) select key from t where size <= 4194304 and size > 0 and status = 'done'")
def _(spark, sf):
    return _tasks(spark, sf).filter("size <= 4194304 and size > 0 and status = 'done'").select("key")


@query("snk08_namespaced", "select distinct agency || '__' || kind as layer, split_part(agency || '__' || kind, '__', 2) as back from features where agency is not null")
def _(spark, sf):
    layer = F.concat("agency", F.lit("__"), "kind")
    return table(spark, sf, "features").filter("agency is not null").select(layer.alias("layer"), F.split_part(layer, F.lit("__"), F.lit(2)).alias("back")).distinct()


@query("x01_batch_response", f"with t as ({_TASKS}) select a.key, b.key is not null as ok from (select key from t where o_custkey % 5 = 0) a left join (select distinct key from t where status = 'done') b using (key)")
def _(spark, sf):
    t = _tasks(spark, sf)
    got = t.filter("status = 'done'").select("key").distinct().withColumn("ok", F.lit(True))
    return t.filter("o_custkey % 5 = 0").select("key").join(got, "key", "left").select("key", F.coalesce("ok", F.lit(False)).alias("ok"))


@query("x13_publication_plan", "select s.r_name as source, z.z, a.area_id from region s, (select unnest([12, 13, 14]) as z) z, areas a where a.kind = 'park' and not (s.r_name = 'ASIA' and z.z > 12)")
def _(spark, sf):
    # A plan of fixed tables: regions x zooms x parks.
    z = F.explode(F.array(*(F.lit(i) for i in (12, 13, 14)))).alias("z")
    s = table(spark, sf, "region").select(F.col("r_name").alias("source"), z).withColumn("on", F.lit(1))
    a = table(spark, sf, "areas").filter("kind = 'park'").select("area_id").withColumn("on", F.lit(1))
    return s.join(small(a), "on").filter(~((F.col("source") == "ASIA") & (F.col("z") > 12))).select("source", "z", "area_id")


@query("x15_usage_status", f"with t as ({_TASKS}) select status as role, cast(sum(size) as bigint) as used, cast(greatest(0, 1000000000 - sum(size)) as bigint) as left from t group by 1")
def _(spark, sf):
    return _tasks(spark, sf).groupBy(F.col("status").alias("role")).agg(F.sum("size").alias("used"), F.greatest(F.lit(0), 1_000_000_000 - F.sum("size")).alias("left"))


@query("x20_accuracy_circle", "with s as (select s_suppkey, radians(s_suppkey % 60) as lat, i, radians(i * 360.0 / 64) as b, 500 / 6371008.8 as d from supplier, (select unnest(range(65)) as i)) select s_suppkey, i, cast(floor(degrees(asin(sin(lat) * cos(d) + cos(lat) * sin(d) * cos(b))) * 1e6) as bigint) as lat6 from s")
def _(spark, sf):
    ring = lines.accuracy_circle(F.lit(-110.0), (F.col("s_suppkey") % 60).cast("double"), F.lit(500.0))
    s = table(spark, sf, "supplier").select("s_suppkey", F.posexplode(ring).alias("i", "p"))
    return s.select("s_suppkey", "i", F.floor(F.col("p.lat") * 1e6).alias("lat6"))


@query("x25_moving_time", "select o_orderkey, (s // 3600) || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as shown from (select o_orderkey, cast(floor(o_totalprice) as bigint) as s from orders)")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", lines.moving_time_text(F.col("o_totalprice")).alias("shown"))


@query("f14_upright", "select p_partkey, case when cos(radians(p_partkey % 360 - 45)) < 0 then (p_partkey % 360 + 180) % 360 else p_partkey % 360 end as angle from part")
def _(spark, sf):
    a = F.col("p_partkey") % 360
    return table(spark, sf, "part").select("p_partkey", F.when(F.cos(F.radians(a - 45)) < 0, (a + 180) % 360).otherwise(a).alias("angle"))


@query("f15_font_ramp", "select p_partkey, cast(floor(case when z <= 5 then 11 when z <= 12 then 11 + (z - 5) * 3.0 / 7 else 14 + (z - 12) * 0.5 end * 100) as bigint) as px from (select p_partkey, p_partkey % 18 as z from part)")
def _(spark, sf):
    z = F.col("p_partkey") % 18
    px = F.when(z <= 5, F.lit(11.0)).when(z <= 12, 11 + (z - 5) * 3.0 / 7).otherwise(14 + (z - 12) * 0.5)
    return table(spark, sf, "part").select("p_partkey", F.floor(px * 100).alias("px"))


@query("f16_url_template", "select id, replace(replace('/t/{z}/{k}.pbf', '{z}', cast(min_zoom as varchar)), '{k}', kind) as url from (select distinct id, min_zoom, kind from landmarks)")
def _(spark, sf):
    l = table(spark, sf, "landmarks").select("id", "min_zoom", "kind").distinct()  # noqa: E741
    url = F.replace(F.replace(F.lit("/t/{z}/{k}.pbf"), F.lit("{z}"), F.col("min_zoom").cast("string")), F.lit("{k}"), F.col("kind"))
    return l.select("id", url.alias("url"))


@query("f18_canonical_json", "select n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' as j from nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("j"))


@query("f20_base64", "select id, to_base64(encode(id)) as b from (select distinct id from facilities where id is not null)")
def _(spark, sf):
    return table(spark, sf, "facilities").filter("id is not null").select("id").distinct().select("id", F.base64(F.encode("id", "utf-8")).alias("b"))


@query("f22_natural_icon", "select distinct id, case when kind = 'waterfall' and regexp_matches(coalesce(name, ''), '(?i)cascade') then 'cascade' else kind end as icon from landmarks")
def _(spark, sf):
    icon = F.when((F.col("kind") == "waterfall") & F.coalesce("name", F.lit("")).rlike("(?i)cascade"), "cascade").otherwise(F.col("kind"))
    return table(spark, sf, "landmarks").select("id", icon.alias("icon")).distinct()


@query("p28_legend", "with i as (select distinct kind as label, agency as src, case agency when 'NPS' then 0 when 'USFS' then 1 else 2 end as p from features where agency is not null), r as (select *, row_number() over (partition by label order by p, src) as rn from i) select label, src from r where rn = 1")
def _(spark, sf):
    p = F.when(F.col("agency") == "NPS", 0).when(F.col("agency") == "USFS", 1).otherwise(2)
    i = table(spark, sf, "features").filter("agency is not null").groupBy(F.col("kind").alias("label")).agg(F.min_by("agency", F.struct(p.alias("p"), "agency")).alias("src"))
    return i


@query("src09_local_query", "select distinct osm_id from osm_elements where elem_id in (3000000001, 3000000010) or (lon between -100 and -95 and lat between 35 and 40)")
def _(spark, sf):
    return table(spark, sf, "osm_elements").filter("elem_id in (3000000001, 3000000010) or (lon between -100 and -95 and lat between 35 and 40)").select("osm_id").distinct()


@query("f04_area_owner", "select area_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as k from areas")
def _(spark, sf):
    return table(spark, sf, "areas").select("area_id", plain_name(F.col("name")).alias("k"))
