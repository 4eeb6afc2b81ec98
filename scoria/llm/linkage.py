"""Matching entities of two sources without keys (problem 5).

Each record's attributes become fixed bit vectors: the q-grams of its name's key, those of
its kind, those of the words that tell places of one name apart, and half rings of bits for
its place. Close pairs are found exactly by multi-index Hamming hashing: of CHUNKS
chunks of the key's vector, two records at Hamming distance below CHUNKS agree in at least
one, so (map cell, chunk number, chunk) is the join key, and a pair is taken at its
first common chunk only. The Dice scores of the fields, weighted, give a score, and the
score a confidence: scores are set against those that chance gives, known from pairs of a
ring farther off, where nothing matches any more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, usable
from ..session import small, store
from .jvm import register, t
from .variants import LEAST, _cell_key, _lon_cell, expand, word_rarity

REACH_M = 700.0
RING_M = 1400.0
CELL = 0.1  # degrees of latitude
CHUNKS = 9
BITS = 7
WEIGHTS = {"name": 0.6, "kind": 0.15, "marks": 0.1, "place": 0.15}
BINS = 50
#: Bits of a place's half ring on each axis; a unit of it in metres.
HALF = 32
UNIT_M = REACH_M / HALF
EARTH_M = 6_371_008.8


def _chunk(bits: Column, i: int) -> Column:
    return F.shiftrightunsigned(bits, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1 if i < CHUNKS - 1 else (1 << (64 - BITS * i)) - 1))


def dice(a: Column, b: Column) -> Column:
    """Dice score of two bit vectors; two empty ones are alike."""
    bits = F.bit_count(a) + F.bit_count(b)
    return F.when(bits == 0, F.lit(1.0)).otherwise(2.0 * F.bit_count(a.bitwiseAND(b)) / bits)


def _prepare(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): records alike in all attributes are one class (n, c, text, kind, lon, lat, bits, size, ids), as of name_classes; members are (c, id)."""
    r = df.select("id", "name", "name_key", F.coalesce("kind", F.lit("")).alias("kind"), F.col("lon").cast("double"), F.col("lat").cast("double"))
    r = r.filter(usable(F.col("lon"), F.col("lat")) & F.col("id").isNotNull() & F.coalesce("name", "name_key").isNotNull())
    c = F.xxhash64("name", "name_key", "kind", "lon", "lat").alias("c")
    classes = r.groupBy("name", "name_key", "kind", "lon", "lat").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size"))
    key, name = F.col("name_key"), F.col("name")
    ids = F.when((F.col("size") <= 2) | (F.col("low") == F.col("high")), F.array_distinct(F.array("low", "high")))
    classes = classes.select(c, "kind", "lon", "lat", "size", ids.alias("ids"), t("NameText", key, name).alias("text"), t("KeyBits", key, name).alias("bits"))
    classes = store(classes.filter(t("NameFamily", F.col("text")).isNotNull()).withColumn("n", F.monotonically_increasing_id()))
    return classes, r.select(c, "id").join(small(classes.filter("ids is null").select("c")), "c").distinct()


def _pairs(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """(na, nb) of classes in neighbouring cells whose vectors differ in fewer than CHUNKS bits."""
    keys = lambda bits: F.explode(F.array(*(_chunk(bits, i) + i * 256 for i in range(CHUNKS))))
    cy = F.floor(F.col("lat") / CELL).cast("int")
    home = a.select("n", "bits", _cell_key(_lon_cell(F.col("lon"), cy, CELL), cy).alias("cell"), keys(F.col("bits")).alias("v"))
    step = reach / 111_000
    visit = b.withColumn("y", F.explode(F.sequence(F.floor((F.col("lat") - step) / CELL).cast("int"), F.floor((F.col("lat") + step) / CELL).cast("int"))))
    wide = F.lit(step) / F.greatest(F.cos(F.radians(F.abs("lat") + 0.01)), F.lit(0.01))
    visit = visit.withColumn("x", F.explode(F.sequence(_lon_cell(F.col("lon") - wide, F.col("y"), CELL), _lon_cell(F.col("lon") + wide, F.col("y"), CELL))))
    visit = visit.select("n", "bits", _cell_key(F.col("x"), F.col("y")).alias("cell"), keys(F.col("bits")).alias("v"))
    h = home.select((F.col("cell") + F.col("v")).alias("k"), F.col("n").alias("na"), F.col("bits").alias("x"))
    v = visit.select((F.col("cell") + F.col("v")).alias("k"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first = F.coalesce(*(F.when(_chunk(differ, i) == 0, i) for i in range(CHUNKS)))
    own = F.shiftright(F.col("k").bitwiseAND(F.lit(16383)), 8)
    return h.join(v, "k").filter((F.bit_count(differ) < CHUNKS) & (first == own)).select("na", "nb")


def _place(lon: Column, lat: Column) -> list[Column]:
    """The vectors of a place on the three axes of the globe."""
    x, y = F.radians(lon), F.radians(lat)
    return [t("PlaceBits", F.floor(v * (EARTH_M / UNIT_M)).cast("bigint")) for v in (F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y))]


def calibrate(inside: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Confidence for each score bin, rising with the score.

    `inside` counts pairs within reach and `chance` what chance gives there. The share beyond
    chance, pooled until it rises with the score, is the confidence.
    """
    n = inside + 1.0
    share = np.clip(1 - (chance + 0.5) / n, 0, 1)  # half a pair more by chance: few pairs prove little
    blocks: list[list[float]] = []  # pooled mean, weight, bins
    for s, k in zip(share, n):
        blocks.append([s, k, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            s2, k2, c2 = blocks.pop()
            s1, k1, c1 = blocks.pop()
            blocks.append([(s1 * k1 + s2 * k2) / (k1 + k2), k1 + k2, c1 + c2])
    return np.concatenate([np.full(int(c), s) for s, _, c in blocks])


def chance_of(ring: dict[int, int]) -> np.ndarray:
    """Pairs within reach by chance for each score bin, from the ring's pairs by hundredths of their score without the place.

    A chance pair is anywhere within reach alike: it is spread over rings of equal area, each with its mean score of place.
    """
    out, rings = np.zeros(BINS), np.sqrt((np.arange(16) + 0.5) / 16)
    share = REACH_M**2 / (RING_M**2 - REACH_M**2) / len(rings)
    for hundredth, n in ring.items():
        at = (hundredth + 0.5) / 100 + WEIGHTS["place"] * (1 - rings / 2)
        np.add.at(out, np.minimum((at * BINS).astype(int), BINS - 1), n * share)
    return out


def match_entities(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b, score, confidence) of records of a and b, smaller id first.

    Both sides have `id`, `name`, `name_key`, `kind`, `lon`, `lat`; other columns are not read. `name_key` comes
    first, the name's own letters where it is null; the name, or else the key parted again, tells words apart.
    Records without an id, a telling name or a usable position match nothing. All pairs within RING_M whose
    key vectors differ in fewer than CHUNKS bits are scored and make the calibration; of those within REACH_M
    the pairs come out whose names and kinds pass an exact check, as vectors may agree where words do
    not. Repeated rows give a pair once, ties need no order, an empty side gives no pairs.
    """
    register(a.sparkSession)
    (a, in_a), (b, in_b) = _prepare(a), _prepare(b)
    rarity = F.lit(word_rarity(a.select("text").unionByName(b.select("text")), "text"))
    side = lambda df, s: df.select(*(F.col(c).alias(f"{c}{s}") for c in ("n", "text", "kind", "lon", "lat", "bits")), *(F.col(c).alias(f"{c}_{s}") for c in ("c", "ids", "size")))
    pairs = _pairs(a, b, RING_M).join(side(a, "a"), "na").join(side(b, "b"), "nb")
    c = F.col
    metres = haversine_m(c("lona"), c("lata"), c("lonb"), c("latb"))
    pairs = pairs.withColumn("metres", metres).filter(c("metres") <= RING_M)
    w = WEIGHTS
    named = (
        w["name"] * dice(c("bitsa"), c("bitsb"))
        + w["kind"] * dice(t("KindBits", c("texta"), c("kinda")), t("KindBits", c("textb"), c("kindb")))
        + w["marks"] * dice(t("MarkBits", c("texta"), rarity), t("MarkBits", c("textb"), rarity))
    )
    place = sum(dice(p, q) for p, q in zip(_place(c("lona"), c("lata")), _place(c("lonb"), c("latb")))) / 3
    alike = t("NameAlike", c("texta"), c("kinda"), c("textb"), c("kindb"), rarity)
    inside = c("metres") <= REACH_M
    scored = store(pairs.select("c_a", "ids_a", "c_b", "ids_b", "size_b", inside.alias("inside"), named.alias("named"), F.when(inside, named + w["place"] * place).alias("score"), F.when(inside, alike >= LEAST).alias("fits")))

    bin_of = F.least(F.floor(c("score") * BINS), F.lit(BINS - 1)).cast("int")
    counts, ring = np.zeros(BINS), {}
    hundredth = F.floor(c("named") * 100).cast("int")
    for row in scored.groupBy("inside", F.when(c("inside"), bin_of).otherwise(hundredth).alias("at")).count().collect():  # at most BINS + 101 rows
        if row["inside"]:
            counts[row["at"]] = row["count"]
        else:
            ring[row["at"]] = row["count"]
    sure = calibrate(counts, chance_of(ring))
    confidence = F.get(F.array(*(F.lit(float(x)) for x in sure)), bin_of)
    good = scored.filter("inside and fits").select("c_a", "ids_a", "c_b", "ids_b", "size_b", "score", confidence.alias("confidence"))
    return expand(good, in_a, in_b, b.filter("ids is null"), ["score", "confidence"])
