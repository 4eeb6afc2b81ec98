"""Checks of networks, grids and alternatives: junctions, doubled roads, seams, and what a review is advised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def connectivity(ends: DataFrame) -> DataFrame:
    """(x, y, kind) of places where lines (id, source, x, y) end: a dead end, a duplicate terminus of one source, or a junction."""
    n = ends.groupBy("x", "y").agg(F.countDistinct("id").alias("lines"), F.countDistinct("source").alias("sources"))
    kind = F.when(F.col("lines") == 1, "dead end").when(F.col("sources") == 1, "duplicate terminus").otherwise("junction")
    return n.select("x", "y", kind.alias("kind"))


def parallel_pairs(lines: DataFrame, row: str, apart: float, least: float, share: float, cell: int = 300) -> DataFrame:
    """(id_a, id_b, shared) of level lines (id, row, x0, x1, y) of one row that run beside each other for a length and a share of the shorter.

    Lines go to cells along x; a pair meets in the cell where what it shares starts, and in no other.
    """
    cells = F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))).alias("cell")
    side = lambda n: lines.select(F.col(row).alias("row"), cells, *(F.col(k).alias(f"{k}_{n}") for k in ("id", "x0", "x1", "y")))
    j = side("a").join(side("b"), ["row", "cell"]).filter((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("y_a") - F.col("y_b")) <= apart))
    start = F.greatest("x0_a", "x0_b")
    j = j.withColumn("shared", F.least("x1_a", "x1_b") - start).filter(F.col("cell") == F.floor(start / cell))
    shorter = F.least(F.col("x1_a") - F.col("x0_a"), F.col("x1_b") - F.col("x0_b"))
    return j.filter((F.col("shared") >= least) & (F.col("shared") >= share * shorter - 1e-9)).select("id_a", "id_b", "shared")


# Coverage under which two lines are not compared, lengths and offsets of a part worth a look, coverage and ratios of a preference.
UNCERTAIN_COVER, NOVEL_M, OFFSET_M, SAME_COVER, SAME_RATIO, DENSER, DENSE_RATIO, REVERSALS = 0.65, 200.0, 75.0, 0.9, 1.08, 1.7, 1.3, 3.0


def recommend(short_cover: Column, novel: Column, offset: Column, loose_ends: Column, least_cover: Column, ratio: Column, denser: Column, reversals_more: Column) -> Column:
    """What a review of two alternatives is advised, the first that applies: uncertain, partial, prefer, or uncertain again.

    `short_cover` is the shorter line's share within 50 m, `least_cover` the lesser share within 15 m, `novel` the most metres outside
    50 m, `offset` the greater offset of nine in ten points, `loose_ends` whether an outlying source has ends beyond 75 m, `ratio`
    the longer over the shorter, `denser` how much closer the one's points are, `reversals_more` its sharp turns a kilometre beyond the other's.
    """
    partial = (novel > NOVEL_M) & ((offset > OFFSET_M) | loose_ends)
    same = (least_cover > SAME_COVER) & (ratio < SAME_RATIO)
    better = (denser >= DENSER) & (ratio < DENSE_RATIO) & (reversals_more <= REVERSALS)
    return F.when(short_cover < UNCERTAIN_COVER, "uncertain").when(partial, "partial").when(same | better, "prefer").otherwise("uncertain")


def seams(cells: DataFrame, width: int, interval: int) -> DataFrame:
    """(id, crossings, open): levels that lie between neighbouring cells on a block's east edge, and those that do not on the next one's west edge.

    `cells` has id (blocks in a row by number), r, c and v; an edge is whole where both blocks cross it in the same levels.
    """
    d = cells.filter("v is not null").withColumn("k", F.floor(F.col("v") / interval))
    w = lambda n: Window.partitionBy("id", "c").orderBy("r")
    level = d.withColumn("below", F.lead("k").over(w(0))).filter("below is not null and k <> below")
    cross = level.select("id", "c", "r", F.explode(F.sequence(F.least("k", "below") + 1, F.greatest("k", "below"))).alias("level"))
    east = cross.filter(F.col("c") == width - 1).select("id", "r", "level")
    west = cross.filter("c = 0").select((F.col("id") - 1).alias("id"), "r", "level", F.lit(1).alias("met"))
    j = east.join(west, ["id", "r", "level"], "left")
    return j.groupBy("id").agg(F.count("*").alias("crossings"), F.count_if(F.col("met").isNull()).alias("open"))


def alignment(points: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, length, spacing): a line's length and the median distance of its points, from points (x, y) in metres."""
    w = Window.partitionBy(*key).orderBy(order)
    step = F.sqrt(F.pow(F.lead("x").over(w) - F.col("x"), 2) + F.pow(F.lead("y").over(w) - F.col("y"), 2))
    s = points.withColumn("_step", step).filter("_step is not null")
    return s.groupBy(*key).agg(F.sum("_step").alias("length"), F.percentile("_step", F.lit(0.5)).alias("spacing"))
