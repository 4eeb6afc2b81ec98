"""Queries of the track and canonicalization operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import canonical, lines, match
from ..operators.classify import lookup
from ..session import table
from ..streaming import track
from .registry import query

_TRACK = """track as (select user_id as device, rn, rn * 5000 + (rn // 17) * 40000 as time_ms, -120 + rn * 1e-4 + (event_id % 7) * 1e-5 as x, 38 + rn * 5e-5 as y,
  cast(event_id % 400 as double) as z, cast(cast(floor(value) as bigint) % 60 as double) as accuracy, cast(event_id % 20 as double) as alt_accuracy, rn // 50 as segment
  from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events))"""


def fixes(spark, sf):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    e = table(spark, sf, "events").withColumn("rn", rn)
    c = F.col
    return e.select(
        c("user_id").alias("device"), (c("rn") * 5000 + F.floor(c("rn") / 17) * 40000).alias("time_ms"), (-120 + c("rn") * 1e-4 + (c("event_id") % 7) * 1e-5).alias("x"),
        (38 + c("rn") * 5e-5).alias("y"), (c("event_id") % 400).cast("double").alias("z"), (F.floor("value").cast("bigint") % 60).cast("double").alias("accuracy"),
        (c("event_id") % 20).cast("double").alias("alt_accuracy"), F.floor(c("rn") / 50).cast("bigint").alias("segment"), "rn",
    )


_M = "2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(t.y - f.ay) / 2), 2) + cos(radians(f.ay)) * cos(radians(t.y)) * pow(sin(radians(t.x - f.ax) / 2), 2))))"


@query("st01_track_stats", f"""with recursive {_TRACK},
  f as (select device, rn, time_ms, segment, case when accuracy between 0 and 50 then time_ms end as am, case when accuracy between 0 and 50 then x end as ax, case when accuracy between 0 and 50 then y end as ay,
    case when accuracy between 0 and 50 then accuracy end as aa, case when accuracy between 0 and 50 and alt_accuracy <= 15 then z end as h, 0.0::double as d, 0.0::double as mv, 0.0::double as g, 1::bigint as n from track where rn = 1
  union all select device, rn, time_ms, segment,
    case when not ok then null when fresh or jump or moved then time_ms else am end, case when not ok then null when fresh or jump or moved then x else ax end, case when not ok then null when fresh or jump or moved then y else ay end,
    case when not ok then null when fresh or jump or moved then accuracy else aa end,
    case when not ok then null when fresh or jump then z2 when not moved then h when z2 is null or h is null then z2 when abs(z2 - h) >= 5 then z2 else h end,
    d + case when ok and moved then m else 0 end, mv + case when ok and moved then (time_ms - am) / 1000.0 else 0 end, g + case when ok and moved and z2 is not null and h is not null and abs(z2 - h) >= 5 then greatest(0, z2 - h) else 0 end, n + 1
  from (select *, not fresh and not jump and not (m < greatest(3, (aa + accuracy) / 2) or m / ((time_ms - am) / 1000.0) < 0.5) as moved from (
    select *, not fresh and ((time_ms - am) / 1000.0 > 30 or m / ((time_ms - am) / 1000.0) > 12) as jump from (
    select t.device, t.rn, t.time_ms, t.segment, t.x, t.y, t.accuracy, f.am, f.ax, f.ay, f.aa, f.h, f.d, f.mv, f.g, f.n, t.accuracy between 0 and 50 as ok, case when t.alt_accuracy <= 15 then t.z end as z2,
      f.am is null or t.segment <> f.segment or t.time_ms - f.time_ms > 30000 as fresh, {_M} as m from f join track t on t.device = f.device and t.rn = f.rn + 1))))
  select device, cast(floor(arg_max(d, rn) * 100 + 1e-6) as bigint) as distance, cast(arg_max(mv, rn) as bigint) as moving_s, cast(arg_max(g, rn) as bigint) as gain, max(n) as points from f group by 1""")
def _(spark, sf):
    s = track.track_stats(fixes(spark, sf))
    return s.select("device", F.floor(F.col("distance") * 100 + 1e-6).alias("distance"), F.col("moving_s").cast("bigint").alias("moving_s"), F.col("gain").cast("bigint").alias("gain"), "points")


@query("st04_sessions", f"with {_TRACK}, g as (select *, case when lag(segment) over w is distinct from segment or time_ms - lag(time_ms) over w > 30000 then 1 else 0 end as new from track window w as (partition by device order by time_ms)) select device, sum(new) as sessions, count(*) as fixes from g group by 1")
def _(spark, sf):
    return lines.sessions(fixes(spark, sf), ["device"], "segment", "time_ms")


@query("w12_fix_deltas", f"with {_TRACK} select device, rn, time_ms - lag(time_ms) over (partition by device, segment order by rn) as dt from track")
def _(spark, sf):
    return lines.deltas(fixes(spark, sf), ["device"], "segment", "rn", "time_ms").select("device", "rn", "dt")


@query("w09_segment_pairs", f"with {_TRACK} select device, rn, cast(floor((lead(x) over w - x) * 1e6 + 0.5) as bigint) as dx from track window w as (partition by device order by rn)")
def _(spark, sf):
    p = lines.pairs(fixes(spark, sf), ["device"], "rn", ["x"])
    return p.select("device", "rn", F.floor((F.col("next_x") - F.col("x")) * 1e6 + 0.5).alias("dx"))


@query("w10_reversals", f"""with {_TRACK}, p as (select device, 3 as ax, lead(accuracy, 1) over w - accuracy as ay, 3 as bx, lead(accuracy, 2) over w - lead(accuracy, 1) over w as b2 from track window w as (partition by device order by rn))
  select device, count(*) filter ((ax * bx + ay * b2) / sqrt((ax * ax + ay * ay) * (bx * bx + b2 * b2)) <= cos(radians(120)) + 1e-9) as reversals from p group by 1""")
def _(spark, sf):
    """Turns by 120 degrees of the line of accuracies, three units a fix."""
    f = fixes(spark, sf).select("device", "rn", (F.col("rn") * 3).alias("x"), F.col("accuracy").alias("y"))
    return lines.reversals(f, ["device"], "rn")


@query("w11_grade", f"with {_TRACK} select device, rn, cast(floor((lead(z, 2) over w - z) / 50 * 1000 + 1e-6) as bigint) as grade from track window w as (partition by device order by rn)")
def _(spark, sf):
    return lines.grades(fixes(spark, sf), ["device"], "rn", "z").select("device", "rn", F.floor(F.col("grade") * 1000 + 1e-6).alias("grade"))


@query("x23_fix_mapping", "select event_id, case when event_id % 9 = 0 or event_id % 11 = 0 then null else value end as speed from events")
def _(spark, sf):
    v = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", lines.finite(v).alias("speed"))


@query("j08_canonicalize")
def _(spark, sf):
    f = table(spark, sf, "features")
    p = F.coalesce(lookup(F.col("agency"), {"NPS": 0, "USFS": 1, "Recreation.gov": 2, "USGS GNIS": 3, "GeoNames": 4}), F.lit(5))
    one = f.filter("id is not null").groupBy("id").agg(*(F.min_by(c, F.struct(F.col(c).isNull(), "ingested_at", F.xxhash64("name", "kind", "lon", "lat"))).alias(c) for c in ("name", "kind", "lon", "lat", "gnis_id", "match_ambiguous")), F.min(p).alias("precedence"))
    return canonical.canonicalize(match.keyed(one))
