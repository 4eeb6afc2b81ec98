"""Evaluation texts leaking into training text (problem 7).

Spaced-seed hashing: fixed masks pick some of the next words and ignore the others, so a
changed word spoils few hashes. The hashes of all test passages are one table. Each
document is hashed once, in the JVM, and keeps the hashes that a Bloom filter of that
table lets pass; these are joined with the table, and each document and item that meet
are compared by a substitution-tolerant local alignment around the places where they met.

The table holds the seeds with a word that few items have, and, wherever a stretch of an item
would be left with too few of those, its other seeds too: no stretch that counts is
without seeds, and sentences that many items share do not meet everything. Items whose
stretches are shorter than the longest mask get shorter masks, down to single words. The
corpus is read once, whatever the number of items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small, store
from .jvm import bit_set, register, t

LEAST_SHARE = 0.4
#: Masks by the least number of words of a stretch that they are for.
MASKS = {7: "11101,110101,1100101,1010011", 3: "11,101", 1: "1"}
#: Items that may share a word for it to count as rare; seeds wanted in every stretch.
RARE_ITEMS, SEEDS_A_STRETCH = 3, 12
#: Of the weight of a stretch, what must be found in order; and cost of a foreign word inside, in mean weights.
LEAST_WEIGHT, FOREIGN = 0.78, 0.1
#: Size of the Bloom filter, as a power of two of bits, beyond which it only lets more hashes pass (16 MB).
FILTER_BITS = 27


def passages(items: DataFrame, item_id: str) -> DataFrame:
    """(item, p, ids, weights, seeds): each distinct passage with its words' hashes and weights, and its seeds."""
    p = items.select(F.col(item_id).cast("long").alias("item"), "passage").filter("item is not null and passage is not null").distinct()
    p = p.select("item", F.xxhash64("item", "passage").alias("p"), t("WordIds", F.col("passage")).alias("ids")).filter(F.size("ids") > 0)
    words = p.select("p", F.posexplode("ids").alias("i", "w"))
    held = words.groupBy("w").agg(F.countDistinct("p").alias("held"))
    by = words.join(held, "w").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("i", "held"))).alias("x"))
    by = by.select("p", F.transform("x", lambda v: v["held"]).alias("held"))
    rows = p.count()
    need = F.ceil(F.size("ids") * F.lit(LEAST_SHARE)).cast("int")
    mask = F.lit(MASKS[1])
    for least in sorted(MASKS)[1:]:
        mask = F.when(need >= least, MASKS[least]).otherwise(mask)
    # Items with short stretches have few seeds, and all of them count.
    wanted = F.when(need >= max(MASKS), F.lit(SEEDS_A_STRETCH)).otherwise(F.lit(1 << 30))
    seeds = t("Choose", F.col("ids"), F.col("held"), mask, need, F.lit(RARE_ITEMS), wanted)
    return p.join(by, "p").select("item", "p", "ids", F.transform("held", lambda k: F.log(F.lit(rows + 1.0) / k) + 0.1).alias("weights"), mask.alias("masks"), seeds.alias("seeds"))


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, share) of every document that gives away a test item.

    `documents` has `text` and its id, `items` a `passage` and a whole-number id; other
    columns are not read. A document is concerned if it holds at least LEAST_SHARE of an
    item's words in one stretch, in order, where case, accents, punctuation, a changed word here and
    there or words put in between do not matter; of an item of one or two words, one word is enough. Whole
    texts are read. Null ids, null and empty texts and passages, and texts without a word are in no case;
    repeated rows give a case once, an id with several texts or passages is in a case if one of them is.
    """
    spark = documents.sparkSession
    register(spark)
    kind = documents.schema[doc_id].dataType
    docs = documents.select(F.col(doc_id).alias("doc"), "text").filter("doc is not null and text is not null")
    index = store(passages(items, item_id))
    seeds = index.select("p", F.explode("seeds").alias("h"))
    masks = sorted({m for row in index.select("masks").distinct().collect() for m in row["masks"].split(",")})  # at most the masks above
    if not masks:
        return spark.createDataFrame([], f"{doc_id} {kind.simpleString()}, {item_id} bigint, share double")
    bits = bit_set(seeds, "h", seeds.count(), FILTER_BITS)

    met = docs.withColumn("hits", t("Hits", F.col("text"), F.lit(bits), ",".join(masks))).filter(F.size("hits") > 0)
    met = store(met.withColumn("row", F.monotonically_increasing_id()))
    places = met.select("row", F.inline("hits")).join(small(seeds), "h").groupBy("row", "p").agg(F.collect_set("at").alias("at"))
    places = small(store(places))
    around = met.select("row", "doc", "text").join(places, "row").join(small(index.select("p", "item", "ids", "weights")), "p")
    out = around.select("doc", "item", t("Stretch", F.col("text"), F.col("at"), F.col("ids"), F.col("weights"), F.lit(FOREIGN)).alias("s"))
    # A word's play at the ends.
    out = out.filter((F.col("s.share") >= LEAST_SHARE - 0.01) & (F.col("s.weight") >= LEAST_WEIGHT))
    return out.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("s.share").alias("share"))
