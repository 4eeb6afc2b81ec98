"""Source records behind merged features: what each source said, kept as JSON lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is read of a record; details stay a map of texts.
RECORD = "struct<id string, agency string, name string, details map<string,string>>"


def records(source_records: Column, id_: Column, agency: Column, name: Column, details: Column | None = None) -> Column:
    """The records of a feature; without any, or where they do not parse, one made of the feature itself."""
    own = F.struct(id_.cast("string").alias("id"), agency.alias("agency"), name.alias("name"), (F.create_map().cast("map<string,string>") if details is None else details).alias("details"))
    read = F.filter(F.from_json(source_records, f"array<{RECORD}>"), lambda r: F.coalesce(r["id"], r["agency"], r["name"]).isNotNull())
    # A text that breaks off is read up to there; only whole ones count.
    return F.when(F.try_parse_json(source_records).isNotNull() & (F.size(read) > 0), read).otherwise(F.array(own))


def original(records_: Column, id_: Column, agency: Column) -> Column:
    """The details that a feature's own source gave, null where no record is its own: others' values are no evidence."""
    return F.get(F.filter(records_, lambda r: (r["id"] == id_.cast("string")) & (r["agency"] == agency)), 0)["details"]


def merge_records(parts: DataFrame, key: list[str], rows: str = "records", order: str | None = None) -> DataFrame:
    """(key, records, source_count): each group's records, one for each agency and id, of which the last in order holds.

    The rows are made single before anything is collected, so a group has as many entries as it has sources.
    """
    at = F.col(order) if order else F.lit(0)
    each = parts.select(*key, at.alias("_at"), F.posexplode(rows).alias("_i", "_r"))
    last = each.groupBy(*key, F.col("_r.agency").alias("_a"), F.col("_r.id").alias("_id")).agg(F.max_by("_r", F.struct("_at", "_i", F.col("_r.name"))).alias("_r"))
    return last.groupBy(*key).agg(F.array_sort(F.collect_list("_r"), lambda x, y: F.when(F.struct(x["agency"], x["id"]) < F.struct(y["agency"], y["id"]), -1).otherwise(1)).alias(rows), F.count("*").alias("source_count"))


def missing_icons(members: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(key, missing): icons that a group shows and no member of it, with its own icon and those listed, stands for.

    `members` has key, icon and icons (a list), `groups` key and icons. A group without members misses all of its icons.
    """
    shown = groups.select(key, F.explode("icons").alias("icon")).distinct()
    have = members.select(key, F.explode(F.array_compact(F.concat(F.array("icon"), F.coalesce("icons", F.array().cast("array<string>"))))).alias("icon")).distinct()
    lost = shown.join(have, [key, "icon"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("icon")).alias("missing"))
    return groups.select(key).distinct().join(lost, key, "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
