"""Variant spellings of names typed by people (problem 1).

A prefix-filtered set-similarity join on the q-grams of the names' words, within reach on
the map, verified by a soft weighted similarity of the words in which rare ones count more.

Records of one table with the same name, kind and position are one class; only
classes are joined, and pairs of records come out at the end. Each class keeps its rarest
q-grams, so many that any name similar to its own shares one of them (the bound is derived in
the kernel from the least similarity). The join key is (cell, q-gram), so a crowded cell or a
common q-gram is split by the other, and a pair lives only if its places are within reach.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, usable
from ..session import small, store
from .jvm import register, t

REACH_M = 700.0
CELL = 0.1  # degrees of latitude
#: Parts of a cell's side to which places are known in the join, 0.7 m.
GRAIN = 16384
#: Similarity from which two names are one; the kernel's filter is derived from it.
LEAST = 0.62
#: Words rarer than one name in so many all weigh alike, so that the table of the others is bounded.
RAREST = 1e-5
#: Members of a class joined by one task; the pairs of larger classes are spread over blocks.
BLOCK = 4096
CODES = 8 * 39 * 39


def _lon_cell(lon: Column, cy: Column, size: float = CELL) -> Column:
    """Column of a cell in its row: cells keep their width in metres, whatever the latitude."""
    wide = F.lit(size) / F.greatest(F.cos(F.radians((F.abs(cy) + 1) * size)), F.lit(0.01))
    return F.floor(lon / wide).cast("int")


def _cell_key(cx: Column, cy: Column) -> Column:
    return (cy.cast("bigint") * 8192 + cx) * 16384


def word_rarity(names: DataFrame, column: str = "name") -> bytes:
    """How common the words of all names are, as the kernel reads it.

    A word weighs the logarithm of names over names with it. Only words of more than RAREST of all names are
    listed: at most 1 / RAREST times the words of a name, whatever the number of names.
    """
    counts = names.select(F.explode(t("NameWords", F.col(column))).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    total = max(1, names.count())
    rows = counts.filter(F.col("k") > total * RAREST).select(t("WordHash", F.col("w")).alias("h"), "k").toLocalIterator()
    listed = sorted((r["h"], math.log1p(total / r["k"])) for r in rows)
    return struct.pack(">f", math.log1p(min(total, 1 / RAREST))) + b"".join(struct.pack(">qf", *x) for x in listed)


def gram_order(names: DataFrame, column: str = "name") -> bytes:
    """A place for each q-gram, the rarest over all names first; at most CODES counts reach the driver."""
    freq = [0] * CODES
    for row in names.select(F.explode(t("NameGrams", F.col(column))).alias("g")).groupBy("g").count().collect():
        freq[row["g"]] = row["count"]
    place = [0] * CODES
    for i, g in enumerate(sorted(range(CODES), key=lambda g: (freq[g], g))):
        place[g] = i
    return struct.pack(f">{CODES}i", *place)


def name_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of records that name a place.

    Records of one table alike in name, kind and position are one class (c, n, name, kind, lon, lat, size, ids):
    `size` is its rows, `ids` its least and greatest id, null where there may be more; the ids of such classes are
    the members (c, id).
    """
    register(records.sparkSession)
    r = records.select(F.col("t").cast("int"), "id", "name", F.coalesce("kind", F.lit("")).alias("kind"), F.col("lon").cast("double"), F.col("lat").cast("double"))
    r = r.filter(usable(F.col("lon"), F.col("lat")) & F.col("id").isNotNull() & F.col("name").isNotNull())
    c = F.xxhash64("t", "name", "kind", "lon", "lat").alias("c")
    classes = r.groupBy("t", "name", "kind", "lon", "lat").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size"))
    family = t("NameFamily", F.col("name"))
    # A class's number, fixed by being written, holds its table in the last two bits and the family that its name says (0 for none) in the next four.
    n = (F.monotonically_increasing_id() * 16 + F.col("family")) * 4 + F.col("t")
    ids = F.when((F.col("size") <= 2) | (F.col("low") == F.col("high")), F.array_distinct(F.array("low", "high")))
    classes = classes.withColumn("family", family).filter("family is not null").select(c, n.alias("n"), "name", "kind", "lon", "lat", "size", ids.alias("ids"))
    classes = store(classes)
    many = classes.filter("ids is null").select("c")
    return classes, r.select(c, "id").join(small(many), "c").distinct()


def link_classes(classes: DataFrame) -> DataFrame:
    """Pairs (c_a, ids_a, c_b, ids_b, size_b, similarity) of classes of different tables that name one place within REACH_M, names unequal."""
    rarity, order = word_rarity(classes), gram_order(classes)
    base = classes.select("n", "lon", "lat", t("NamePrefix", F.col("name"), F.lit(rarity), F.lit(order)).alias("rare"))
    table_of = F.col("n").bitwiseAND(F.lit(3))
    home = base.filter(table_of < 2).withColumn("cy", F.floor(F.col("lat") / CELL).cast("int")).withColumn("cx", _lon_cell(F.col("lon"), F.col("cy")))
    step = REACH_M * 1.01 / 111_000
    visit = base.filter(table_of > 0).withColumn("cy", F.explode(F.sequence(F.floor((F.col("lat") - step) / CELL).cast("int"), F.floor((F.col("lat") + step) / CELL).cast("int"))))
    wide = F.lit(step) / F.greatest(F.cos(F.radians(F.abs("lat") + 0.02)), F.lit(0.01))
    visit = visit.withColumn("cx", F.explode(F.sequence(_lon_cell(F.col("lon") - wide, F.col("cy")), _lon_cell(F.col("lon") + wide, F.col("cy")))))
    # A place in a cell goes as two times 16 bits, in GRAINs of the cell, which has the same metres both ways.
    grains = lambda v, size, at: F.floor((v / size - at) * GRAIN).cast("int") + 16384
    width = F.lit(CELL) / F.greatest(F.cos(F.radians((F.abs("cy") + 1) * CELL)), F.lit(0.01))
    place = F.shiftleft(grains(F.col("lon"), width, F.col("cx")), 16) + grains(F.col("lat"), F.lit(CELL), F.col("cy"))
    side = lambda df, s: df.select((_cell_key(F.col("cx"), F.col("cy")) + F.col("g")).alias("k"), F.col("n").alias(f"n{s}"), F.col("p").alias(f"p{s}"))
    keyed = lambda df: df.withColumn("p", place).select("n", "cx", "cy", "p", F.explode("rare").alias("g"))
    ordered = F.col("na").bitwiseAND(F.lit(3)) < F.col("nb").bitwiseAND(F.lit(3))
    fa, fb = (F.shiftright(v, 2).bitwiseAND(F.lit(15)) for v in ("na", "nb"))
    fits = (fa == 0) | (fb == 0) | (fa == fb)
    dx, dy = (a.cast("bigint") - b for a, b in ((F.shiftrightunsigned("pa", 16), F.shiftrightunsigned("pb", 16)), (F.col("pa").bitwiseAND(F.lit(65535)), F.col("pb").bitwiseAND(F.lit(65535)))))
    # A cell's row is up to two hundredths wider in metres than its upper edge; a grain more for the rounding. Near the poles nothing is left out.
    reach = int(REACH_M * 1.03 / (CELL * 111_194) * GRAIN) + 2
    polar = F.abs(F.floor(F.col("k") / (16384 * 8192))) > 85 / CELL
    near = polar | (dx * dx + dy * dy <= reach * reach)
    pairs = side(keyed(home), "a").join(side(keyed(visit), "b"), "k").filter(ordered & fits & near).select("na", "nb")
    say = lambda s: classes.select(F.col("n").alias(f"n{s}"), *(F.col(v).alias(f"{v}_{s}") for v in ("name", "kind", "lon", "lat", "c", "ids", "size")))
    # Partitioned by one class, pairs are made distinct and joined without another shuffle.
    pairs = pairs.repartition("na").distinct().join(say("a"), "na").join(say("b"), "nb").filter("name_a <> name_b")
    pairs = pairs.filter(haversine_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")) <= REACH_M)
    alike = t("NameAlike", *(F.col(v) for v in ("name_a", "kind_a", "name_b", "kind_b")), F.lit(rarity))
    return pairs.select("c_a", "ids_a", "c_b", "ids_b", "size_b", alike.alias("similarity")).filter(F.col("similarity") >= LEAST)


def link_variants(records: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b, similarity) of records of different tables that name one place.

    `records` has `t` (int, the table's number, 0 to 2), `id`, `name`, `kind`, `lon`, `lat`; other columns are not
    read. Names that say nothing or only a kind of place, null names and ids, and records without a usable position
    link to nothing. Names equal character by character are no variants and give no pair. Repeated rows give a
    pair once. Names of any length are taken whole; one of more than 64 words counts as one long word. Empty
    tables give no pairs. Of names of several words, a word may stand as two in the other name.
    """
    classes, members = name_classes(records)
    return expand(link_classes(classes), members, members, classes.filter("ids is null"), ["similarity"])


def expand(pairs: DataFrame, members_a: DataFrame, members_b: DataFrame, many_b: DataFrame, keep: list[str]) -> DataFrame:
    """(id_a, id_b, kept values at their greatest) of pairs (c_a, ids_a, c_b, ids_b, size_b, kept values) of classes, smaller id first.

    Classes whose ids are null have them in members (c, id); pairs of large ones are joined block by block, so that no
    task has all pairs of two. `many_b` are those classes of b (c, size).
    """
    few = pairs.filter("ids_a is not null").withColumn("ia", F.explode("ids_a"))
    many = pairs.filter("ids_a is null").join(members_a.select(F.col("c").alias("c_a"), F.col("id").alias("ia")), "c_a")
    half = few.unionByName(many.select(few.columns)).drop("c_a", "ids_a")
    few = half.filter("ids_b is not null").withColumn("ib", F.explode("ids_b"))
    blocks = lambda size: F.ceil(size / BLOCK).cast("int")
    large = small(many_b.select(F.col("c").alias("c_b"), blocks(F.col("size")).alias("blocks")))
    inside = members_b.select(F.col("c").alias("c_b"), F.col("id").alias("ib")).join(large, "c_b").withColumn("block", F.pmod(F.xxhash64("ib"), F.col("blocks")).cast("int"))
    many = half.filter("ids_b is null").withColumn("block", F.explode(F.sequence(F.lit(0), blocks(F.col("size_b")) - 1))).join(inside, ["c_b", "block"])
    out = few.unionByName(many.select(few.columns)).groupBy(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    return out.agg(*(F.max(k).alias(k) for k in keep))


def place_records(landmarks: DataFrame, features: DataFrame, osm: DataFrame) -> DataFrame:
    """The three tables' records in one form for link_variants."""
    tags = F.col("tags")
    kind = F.coalesce(*(tags[k] for k in ("natural", "tourism", "amenity", "highway", "waterway")), F.when(tags["mountain_pass"].isNotNull(), "pass"))
    return (
        landmarks.select(F.lit(0).alias("t"), "id", "name", "kind", "lon", "lat")
        .unionByName(features.select(F.lit(1).alias("t"), "id", "name", "kind", "lon", "lat"))
        .unionByName(osm.select(F.lit(2).alias("t"), F.col("osm_id").alias("id"), tags["name"].alias("name"), kind.alias("kind"), "lon", "lat"))
    )
