"""Queries of the general training-data operators (core), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nearby import containing_regions, near_pairs
from ..operators.rejects import parse_lines, split_rejects, typed_gnis
from ..session import table

NEAR_M = 150.0


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_pairs(
        table(spark, sf, "landmarks"), table(spark, sf, "facilities"), NEAR_M, names=("landmark_id", "facility_id")
    )


def p2_regions(spark: SparkSession, sf: str) -> DataFrame:
    facilities = table(spark, sf, "facilities").select(F.col("id").alias("facility_id"), "lon", "lat")
    return containing_regions(facilities, table(spark, sf, "areas")).select("facility_id", "area_id").distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(table(spark, sf, "gnis_lines")).filter(F.col("reason").isNotNull()).select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = split_rejects(table(spark, sf, "gnis_lines"))
    f = F.col("fields")
    return typed_gnis(good).select(
        "line_id", "feature_id", f["feature_name"].alias("feature_name"), f["feature_class"].alias("feature_class"), "lat", "lon"
    )


_OK = "(lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0))"
_FIELD = '(?:"(?:[^"]|"")*"|[^"|]*)'
_LINES = f"""
with m as (
  select line_id, raw_line, regexp_full_match(raw_line, '(?s){_FIELD}(?:[|]{_FIELD})*') as q,
    regexp_extract_all(raw_line || '|', '(?s)({_FIELD})[|]', 1) as f from gnis_lines),
u as (
  select line_id, raw_line, q, len(f) as n,
    [case when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end for x in f] as f from m),
v as (select *, f[1] as fid, f[9] as lat, f[10] as lon from u),
r as (
  select *, case when raw_line is null then 'column_count' when not q then 'quoting' when n <> 10 then 'column_count'
    when not (regexp_full_match(fid, '[0-9]+') and coalesce(try_cast(fid as hugeint) between 1 and 9223372036854775807, false)) then 'feature_id'
    when not (regexp_full_match(lat, '[+-]?[0-9]+([.][0-9]+)?') and coalesce(abs(try_cast(lat as double)) <= 90, false)) then 'prim_lat_dec'
    when not (regexp_full_match(lon, '[+-]?[0-9]+([.][0-9]+)?') and coalesce(abs(try_cast(lon as double)) <= 180, false)) then 'prim_long_dec'
  end as reason from v)
"""

QUERIES = {"p2_found": p2_found, "p2_regions": p2_regions, "p3_found": p3_found, "p3_loaded": p3_loaded}

ORACLE = {
    "p2_found": f"""
with a as (select distinct id, lon, lat, cast(floor(lat * 500) as bigint) as band from landmarks where id is not null and {_OK}),
b as (select distinct id, lon, lat, unnest([-1, 0, 1]) + cast(floor(lat * 500) as bigint) as band from facilities where id is not null and {_OK})
select distinct a.id as landmark_id, b.id as facility_id from a join b using (band)
where 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= {NEAR_M}""",
    "p2_regions": f"""
select distinct f.id as facility_id, a.area_id from facilities f join areas a
on f.lon between a.west and a.east and f.lat between a.south and a.north where {_OK}""",
    "p3_found": _LINES + "select line_id, reason from r where reason is not null",
    "p3_loaded": _LINES
    + """select line_id, cast(fid as bigint) as feature_id, f[2] as feature_name, f[3] as feature_class,
  cast(lat as double) as lat, cast(lon as double) as lon from r where reason is null""",
}
