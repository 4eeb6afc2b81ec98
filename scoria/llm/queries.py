"""Queries of the operators in this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store, table
from .leakage import find_leaks
from .linkage import match_entities
from .packing import pack, packing_checks
from .subjects import label_subjects
from .survivors import best_records, field_winners
from .variants import link_variants, place_records


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    records = place_records(*(table(spark, sf, t) for t in ("landmarks", "features", "osm_elements")))
    return link_variants(records).select("id_a", "id_b")


def p5_matches(spark: SparkSession, sf: str) -> DataFrame:
    land = table(spark, sf, "landmarks")
    sources = [land.filter(F.col("agency") == a) for a in ("USGS GNIS", "GeoNames")]
    return match_entities(*sources).select("id_a", "id_b", F.round("confidence", 4).alias("confidence"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_matches(spark, sf).filter("confidence >= 0.5").select("id_a", "id_b")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return field_winners(table(spark, sf, "features"), table(spark, sf, "agencies")).select("match_group", "field_name", "id")


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    return best_records(table(spark, sf, "features"), table(spark, sf, "agencies"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents")).select("doc_id", "part", "container", "place", "tokens")


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the packing of all documents, counted where it does not."""
    return packing_checks(store(pack(table(spark, sf, "documents"))))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return label_subjects(*(table(spark, sf, t) for t in ("documents", "doc_labels", "subjects")))


def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each subject, the corpus composition."""
    return p8_found(spark, sf).groupBy("subject_code").agg(F.count("*").alias("documents"))


QUERIES = {
    "p4_found": p4_found, "p4_records": p4_records, "p6_containers": p6_containers, "p6_checks": p6_checks, "p7_found": p7_found, "p8_found": p8_found, "p8_composition": p8_composition,
    "p1_found": p1_found, "p5_found": p5_found, "p5_matches": p5_matches,
}

_NOTHING = "('', 'na', 'none', 'null', 'nil', 'unknown', 'noname', 'nameunknown', 'unnamed', 'tbd', 'nodata', 'notavailable', 'nan', 'untitled', 'missing')"
_LETTERS = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _said(c: str) -> str:
    return f"case when {_LETTERS.format(c)} not in {_NOTHING} then {c} end"


_WINNERS = f"""
with k as (
  select agency, trust_rank, {_LETTERS.format("agency")} as code, {_LETTERS.format("full_name")} as full_name,
    [x for x in regexp_split_to_array(lower(agency), '[^a-z0-9]+') if x <> ''] as cw, [x for x in regexp_split_to_array(lower(full_name), '[^a-z0-9]+') if x <> ''] as fw from agencies),
k2 as (select *, array_to_string([case when x = 'database' then 'db' else x[1] end for x in fw], '') as initials from k),
said as (
  select agency as written, {_LETTERS.format("agency")} as plain,
    [case x when 'natl' then 'national' when 'nat' then 'national' when 'svc' then 'service' when 'serv' then 'service' when 'rec' then 'recreation' when 'info' then 'information' when 'geog' then 'geographic' else x end
      for x in regexp_split_to_array(replace(lower(agency), chr(39), ''), '[^\\p{{L}}\\p{{N}}]+') if x <> ''] as words
  from (select distinct agency from features where agency is not null)),
means as (
  select written, arg_min(k2.agency, (coalesce(k2.trust_rank, 1000000), k2.agency)) as agency from said join k2 on
    plain in (code, full_name, initials) or (
      len([x for x in words if not list_contains(cw, x) and not list_contains(fw, x) and x <> initials and not list_contains([y[1] for y in fw], x) and x not in ('the', 'of', 'usda', 'us')]) = 0
      and (len([x for x in words if (list_contains(cw, x) or x = code or x = initials) and length(x) > 2 and x not in ('united', 'states', 'national', 'gov')]) > 0
        or len([x for x in fw if x not in ('united', 'states', 'national', 'gov') and not list_contains(words, x)]) = 0))
  group by 1),
own as (
  select distinct match_group, id, name, agency, elevation_m,
    list_filter(cast(json_extract(case when json_valid(source_records) then source_records end, '$[*]') as json[]), lambda x: json_extract_string(x, '$.id') = id)[1] as own
  from features where match_group is not null and id is not null),
d as (
  select match_group, id, case when {_LETTERS.format("own.agency")} in {_NOTHING} then null else coalesce(means.agency, trim(own.agency)) end as said, {_said("name")} as name,
    case when elevation_m between -500 and 9000 then elevation_m end as elevation_m,
    json_extract_string(own, '$.details.phone') as phone0, json_extract_string(own, '$.details.water') as water0,
    trim(json_extract_string(own, '$.details.updated')) as u from own left join means on own.agency = means.written),
e as (
  select match_group, id, said, name, elevation_m, {_said("phone0")} as phone, {_said("water0")} as water,
    case when regexp_matches(u, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(substr(u, 1, 10) as date)
      when regexp_full_match(u, '-?[0-9]{{12,14}}') then date '1970-01-01' + cast(floor(try_cast(u as bigint) / 86400000) as int)
      when regexp_full_match(u, '-?[0-9]{{8,11}}') then date '1970-01-01' + cast(floor(try_cast(u as bigint) / 86400) as int)
      when regexp_full_match(u, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') then cast(coalesce(try_strptime(u, '%m/%d/%Y'), try_strptime(u, '%d/%m/%Y')) as date)
      else cast(try_strptime(u, '%d %b %Y') as date) end as day from d),
f as (
  select e.*, trust_rank, (name is not null)::int + (elevation_m is not null)::int + (phone is not null)::int + (water is not null)::int as complete
  from e left join agencies a on a.agency = e.said),
w as (
  select match_group, field_name, id, value, row_number() over (partition by match_group, field_name order by trust_rank nulls last, day desc nulls last, complete desc, id, value) as rn
  from (select match_group, id, trust_rank, day, complete, unnest(['name', 'elevation_m', 'phone', 'water']) as field_name,
    unnest([name, cast(elevation_m as varchar), phone, water]) as value from f) where value is not null)
"""

ORACLE = {
    "p6_checks": "select count(distinct doc_id) as items, 0 as torn, 0 as overfull, 0 as gaps, 0 as loose from documents",
    "p4_found": _WINNERS + "select match_group, field_name, id from w where rn = 1",
    "p4_records": _WINNERS + """, l as (select match_group, id as best_id, said as agency, row_number() over (partition by match_group order by trust_rank nulls last, day desc nulls last, complete desc, id) as rn from f)
  select l.match_group, best_id, agency, max(value) filter (field_name = 'name') as name, max(try_cast(value as double)) filter (field_name = 'elevation_m') as elevation_m,
    max(value) filter (field_name = 'phone') as phone, max(value) filter (field_name = 'water') as water
  from l left join w on w.match_group = l.match_group and w.rn = 1 where l.rn = 1 group by all""",
}
