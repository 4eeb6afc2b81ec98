"""Label ranking: scores, earliest zooms, order within a family, and thinning over zooms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mercator import world_x, world_y
from ..session import fresh, small, store
from .classify import lookup

# Weights of places to go to, kinds that are details, landmarks by zoom and score.
DESTINATION = {"visitor_center": 95, "ranger_station": 90, "trailhead": 80, "shelter": 80, "campground": 75, "backcountry_camp": 75, "viewpoint": 65, "lodging": 60, "picnic_site": 45, "information": 40}
DETAIL = ("restroom", "drinking_water", "store", "food", "first_aid")
LANDMARK_ZOOM = {"pass": 11, "waterfall": 12, "arch": 13, "rock": 13, "cave": 14, "spring": 14}
LANDMARK_SCORE = {"pass": 65, "waterfall": 60, "arch": 50, "rock": 45, "cave": 35, "spring": 30}
KNOWN_HEIGHT = (-500, 9000)


def _ladder(value: Column, steps: list[tuple[float, int]], last: int) -> Column:
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, zoom in steps[1:]:
        out = out.when(value >= least, zoom)
    return out.otherwise(last)


def summit_score(higher_km: Column, near_km: Column, height: Column) -> Column:
    """struct(score, earliest): by the way to the next higher summit, else by the way to the next summit."""
    known = F.struct(
        (100 * F.log1p(higher_km) + F.greatest(F.lit(0.0), height) * 0.035).alias("score"),
        _ladder(higher_km, [(250, 6), (70, 7), (25, 8), (8, 9), (2, 10), (0.7, 11), (0.2, 12)], 13).alias("earliest"),
    )
    other = F.struct((35 * F.log1p(near_km)).alias("score"), F.when(near_km >= 10, 11).otherwise(12).alias("earliest"))
    return F.when(higher_km.isNotNull(), known).otherwise(other)


def destination_score(kind: Column, near_km: Column) -> Column:
    """struct(score, earliest) of a place to go to: its weight and how far the next one is."""
    weight = lookup(kind, DESTINATION)
    zoom = F.when((near_km >= 15) & (weight >= 60), 9).when((near_km >= 3) & (weight >= 60), 10).when(weight >= 75, 11).otherwise(12)
    return F.struct((weight + 12 * F.log1p(F.least(near_km, F.lit(40.0)))).alias("score"), zoom.alias("earliest"))


def landmark_score(kind: Column, min_zoom: Column) -> Column:
    """struct(score, earliest) of any other landmark."""
    return F.struct(
        F.coalesce(lookup(kind, LANDMARK_SCORE), F.lit(20)).cast("double").alias("score"),
        F.coalesce(lookup(kind, LANDMARK_ZOOM), min_zoom, F.lit(14)).alias("earliest"),
    )


def with_rank(df: DataFrame) -> DataFrame:
    """Position within the family by falling score, then id, from 0.

    Families do not grow in number, so none is sorted by one task: rows are parted by ranges of the order, numbered within
    their part, and shifted by the rows of the family in the parts before, of which there are few counts.
    """
    part, before, of, at = fresh(df, "part", "before", "of_family", "at_part")
    order = [F.col("score").desc(), F.col("id")]
    parted = store(df.repartitionByRange(F.col("family"), *order).withColumn(part, F.spark_partition_id()))
    sizes = parted.groupBy("family", part).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("family").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("family").alias(of), F.col(part).alias(at), F.coalesce(ahead, F.lit(0)).alias(before))
    out = parted.join(small(sizes), F.col("family").eqNullSafe(F.col(of)) & (F.col(part) == F.col(at))).drop(of, at)
    return out.withColumn("rank", (F.row_number().over(Window.partitionBy("family", part).orderBy(*order)) - 1 + F.col(before)).cast("int")).drop(part, before)


def thin(df: DataFrame, spacing: float = 104, detail_spacing: float | None = None, zooms: range = range(6, 14)) -> DataFrame:
    """(id, zoom): the first zoom at which a label is shown without crowding a shown one.

    At each zoom, records whose earliest zoom has come are taken by falling score, then id, unless one
    already taken lies closer than the spacing; what is taken stays. That is the first maximal independent set
    in score order, found in rounds of joins: whoever precedes all open neighbours is taken, their neighbours
    drop out, until nobody is open. What is never taken gets max(14, earliest).
    `df` has distinct `id`, and `lon`, `lat`, `score`, `earliest`.
    """
    base = store(df.select("id", "score", "earliest", world_x(F.col("lon")).alias("x"), world_y(F.col("lat")).alias("y")))
    taken = base.limit(0).select("id", "x", "y", F.lit(0).alias("zoom"))
    for z in zooms:
        px = detail_spacing if detail_spacing and z >= 10 else spacing
        radius = px / (512 * 2**z)
        columns = max(1, int(1 / radius))
        cell = lambda c: F.floor(c * columns)
        d = F.array(F.lit(-1), F.lit(0), F.lit(1))
        around = lambda t: t.withColumn("cx", F.explode(F.transform(d, lambda k: F.pmod(cell(F.col("x")) + k, F.lit(columns))))).withColumn("cy", F.explode(F.transform(d, lambda k: cell(F.col("y")) + k)))  # noqa: E731, B023
        home = lambda t: t.withColumn("cx", F.pmod(cell(F.col("x")), F.lit(columns))).withColumn("cy", cell(F.col("y")))  # noqa: E731, B023

        def near(u: str, v: str, r: float = radius) -> Column:
            dx = F.abs(F.col(f"{u}.x") - F.col(f"{v}.x"))
            dx = F.least(dx, 1 - dx)
            return dx * dx + F.pow(F.col(f"{u}.y") - F.col(f"{v}.y"), 2) < r * r

        free = home(base.filter(F.col("earliest") <= z).join(taken.select("id"), "id", "left_anti"))
        same = [F.col("u.cx") == F.col("v.cx"), F.col("u.cy") == F.col("v.cy")]
        open_ = free.alias("u").join(around(taken).alias("v"), [*same, near("u", "v")], "left_anti").select("id", "x", "y", "score")
        open_ = store(open_)
        edges = home(open_).alias("u").join(around(open_).alias("v"), [*same, F.col("u.id") != F.col("v.id"), near("u", "v")])
        before = (F.col("v.score") > F.col("u.score")) | ((F.col("v.score") == F.col("u.score")) & (F.col("v.id") < F.col("u.id")))
        edges = store(edges.select(F.col("u.id").alias("id"), F.col("v.id").alias("other"), before.alias("before")).distinct())
        while True:
            blocked = edges.filter("before").select("id").distinct()
            won = store(open_.join(blocked, "id", "left_anti"))
            if won.isEmpty():
                break
            taken = store(taken.unionByName(won.select("id", "x", "y", F.lit(z).alias("zoom"))))
            gone = won.select("id").union(edges.join(won.select(F.col("id").alias("other")), "other").select("id")).distinct()
            open_ = store(open_.join(gone, "id", "left_anti"))
            gone = gone.select(F.col("id").alias("g"))
            edges = store(edges.join(gone, F.col("id") == F.col("g"), "left_anti").join(gone, F.col("other") == F.col("g"), "left_anti"))
    left = base.join(taken.select("id", "zoom"), "id", "left")
    return left.select("id", F.coalesce("zoom", F.greatest(F.lit(14), F.col("earliest"))).alias("zoom"))
