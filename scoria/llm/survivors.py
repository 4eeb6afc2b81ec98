"""Best representative of each duplicate group (problem 4).

Records are ranked for each field by trust, recency and completeness with a
deterministic tie-break, by a window that keeps the top row. Spark puts a partial
limit before the window's shuffle, so a task sends at most one row for each group and field:
a group with a third of all rows costs no more than any other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import NO_NAME

FIELDS = ("name", "elevation_m", "phone", "water")
#: Heights outside are codes for a missing value.
HEIGHTS = (-500.0, 9000.0)
# Short forms of words in agencies' names; words that any of them may have; words by which none is known.
SHORT_WORDS = {"natl": "national", "nat": "national", "svc": "service", "serv": "service", "rec": "recreation", "info": "information", "geog": "geographic"}
FREE_WORDS = ("the", "of", "usda", "us")
COMMON_WORDS = ("united", "states", "national", "gov")
#: Agencies that a table may have: each is a branch of one expression.
MAX_AGENCIES = 1000
_OWN = "array<struct<id string, agency string, details struct<updated string, phone string, water string>>>"


def letters(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def telling(c: Column) -> Column:
    """The text, or null where it only says that a value is missing."""
    return F.when(~letters(c).isin(*sorted(NO_NAME)), c)


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", re.sub(r"['\u2019]", "", text.lower())) if w]


def _known_as(agency: str, full_name: str | None) -> tuple[list[str], list[str], list[str], list[str]]:
    """How an agency may be written: whole, by words, of which its own or all telling ones are there."""
    code, full = _words(agency), _words(full_name or "")
    initials = "".join("db" if w == "database" else w[0] for w in full)
    plain = lambda words: "".join(words)
    whole = {plain(code), plain(full), initials} - {""}
    allowed = {*code, *full, initials, *(w[0] for w in full), *FREE_WORDS}
    own = {w for w in (*code, plain(code), initials) if len(w) > 2} - set(COMMON_WORDS)
    return sorted(whole), sorted(allowed), sorted(own), sorted(set(full) - set(COMMON_WORDS))


def canonical_agency(c: Column, agencies: list[tuple[str, str | None]]) -> Column:
    """The agency of the table, (agency, full_name) by trust, that a written name means, or the name as it stands.

    An agency is meant where its name, its full name or its initials are written, whatever the signs and case; or where all
    words are from these, in full or short, and among them one by which it alone is known or all telling words of its full name.
    """
    plain = letters(c)
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "['\u2019]", ""), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.coalesce(F.create_map(*(F.lit(x) for kv in SHORT_WORDS.items() for x in kv))[w], w))
    listed = lambda values: F.array(*(F.lit(v) for v in values)).cast("array<string>")
    out = F.when(plain.isin(*sorted(NO_NAME)), F.lit(None).cast("string"))
    for agency, full_name in agencies:
        whole, allowed, own, telling_words = _known_as(agency, full_name)
        said = F.arrays_overlap(words, listed(own))
        if telling_words:
            said = said | (F.size(F.array_except(listed(telling_words), words)) == 0)
        out = out.when(plain.isin(*whole) | ((F.size(F.array_except(words, listed(allowed))) == 0) & said), agency)
    return out.otherwise(F.trim(c))


def written_day(c: Column) -> Column:
    """The day that a written date means, or null.

    Read are year-month-day with or without a time, month/day/year (day/month/year where
    the first number is above 12), day month-name year, and seconds or milliseconds since 1970.
    """
    t = F.trim(c)
    at = lambda text, form: F.try_to_timestamp(text, F.lit(form)).cast("date")
    slashed = F.regexp_extract(t, r"^(\d{1,2})/\d{1,2}/\d{4}$", 1).try_cast("int")
    named = F.regexp_replace(t, r"^(\d{1,2}) ([A-Za-z]{3})[a-z]*\.? (\d{4})$", "$1 $2 $3")
    since = F.lit("1970-01-01").cast("date")
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), at(F.substring(t, 1, 10), "yyyy-MM-dd"))
        .when(t.rlike(r"^-?\d{12,14}$"), F.date_add(since, F.floor(t.try_cast("bigint") / 86_400_000).cast("int")))
        .when(t.rlike(r"^-?\d{8,11}$"), F.date_add(since, F.floor(t.try_cast("bigint") / 86_400).cast("int")))
        .when(slashed > 12, at(t, "d/M/yyyy"))
        .when(slashed.isNotNull(), at(t, "M/d/yyyy"))
        .when(named.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), at(F.initcap(named), "d MMM yyyy"))
    )


def _values(features: DataFrame, agencies: DataFrame) -> DataFrame:
    """Grouped records with their four fields (null where nothing is said), trust and day."""
    own = F.get(F.filter(F.from_json("source_records", _OWN), lambda e: e["id"] == F.col("id")), 0)
    known = agencies.filter("agency is not null").groupBy("agency").agg(F.min("trust_rank").alias("trust_rank"), F.min("full_name").alias("full_name"))
    known = known.orderBy(F.col("trust_rank").asc_nulls_last(), "agency").limit(MAX_AGENCIES + 1).collect()
    if len(known) > MAX_AGENCIES:
        raise ValueError(f"more than {MAX_AGENCIES} agencies")
    said = canonical_agency(F.col("agency"), [(r["agency"], r["full_name"]) for r in known])
    f = features.filter(F.col("match_group").isNotNull() & F.col("id").isNotNull()).select(
        "match_group", "id", said.alias("said"), F.col("name"), F.col("elevation_m"), own.alias("own")
    )
    details = F.col("own")["details"]
    high = F.col("elevation_m")
    f = f.select(
        "match_group", "id", "said", telling(F.col("name")).alias("name"), F.when(high.between(*HEIGHTS), high).alias("elevation_m"),
        telling(details["phone"]).alias("phone"), telling(details["water"]).alias("water"), written_day(details["updated"]).alias("day"),
    )
    ranked = [x for r in known if r["trust_rank"] is not None for x in (F.lit(r["agency"]), F.lit(r["trust_rank"]))]
    rank = F.create_map(*ranked)[F.col("said")] if ranked else F.lit(None).cast("int")
    full = sum((F.col(c).isNotNull().cast("int") for c in FIELDS), F.lit(0))
    return f.withColumn("trust_rank", rank).withColumn("complete", full)


def _order() -> list[Column]:
    return [F.col("trust_rank").asc_nulls_last(), F.col("day").desc_nulls_last(), F.col("complete").desc(), F.col("id").asc()]


def field_winners(features: DataFrame, agencies: DataFrame) -> DataFrame:
    """(match_group, field_name, id, value): the record whose value the best record takes.

    A value is null, or a text or number that only says it is missing, where nothing is
    said; a field without any value in its group has no row. Of the rest, the one of the
    most trusted agency wins (agencies not in the table, or not named, come last), then the latest
    day, then the record with more fields, then the smaller id. Unreadable or missing
    `source_records` give no phone, water or day. Rows without a group or an id are left
    out; repeated rows count once; an empty table gives no rows.
    """
    v = _values(features, agencies)
    each = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in FIELDS))
    rows = v.withColumn("x", F.explode(F.filter(each, lambda x: x["value"].isNotNull()))).select(
        "match_group", F.col("x.field_name"), F.col("x.value"), "trust_rank", "day", "complete", "id"
    )
    top = Window.partitionBy("match_group", "field_name").orderBy(*_order(), "value")
    return rows.withColumn("rn", F.row_number().over(top)).filter("rn = 1").select("match_group", "field_name", "id", "value")


def best_records(features: DataFrame, agencies: DataFrame) -> DataFrame:
    """One record for each group: its best row's id and every field from its own winner."""
    v = _values(features, agencies)
    top = Window.partitionBy("match_group").orderBy(*_order())
    lead = v.withColumn("rn", F.row_number().over(top)).filter("rn = 1").select("match_group", F.col("id").alias("best_id"), F.col("said").alias("agency"))
    fields = field_winners(features, agencies).groupBy("match_group").agg(
        *(F.max(F.when(F.col("field_name") == c, F.col("value"))).alias(c) for c in FIELDS)
    )
    return lead.join(fields, "match_group", "left").withColumn("elevation_m", F.col("elevation_m").cast("double"))
