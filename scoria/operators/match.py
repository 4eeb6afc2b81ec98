"""Conservative matching of place records: blocked equi-joins with a distance residual.

Blocks are (family of kinds, name key, map cell) and shared external ids; a pair is never made outside
a block, so a common name costs only within one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, unit_xyz, usable
from ..functions.names import name_key
from ..session import store
from .nearby import VantageTree, _assign, _counts, _inner_pivots, _part_again, _pivots, _reached, _with_cell

# Keys of names that say only the kind of place.
GENERIC = ("", "camp", "campground", "trailhead", "visitorcenter", "restroom", "restrooms", "toilet", "toilets", "water", "waterpoint", "waterfountain",
           "drinkingwater", "spring", "peak", "summit", "shop", "store", "picnicarea", "viewpoint", "information")
FAR_M, SURVEY_M, SHARED_ID_M = 300, 750, 5000
#: Degrees of a block's cell; wider than the longest reach of a name match.
STEP = 0.02


def reach_m(kind: Column) -> Column:
    """How far apart two records of a kind may lie and be one place by name."""
    return F.when(kind.isin("summit", "rock", "pass"), 300).when(kind.isin("restroom", "drinking_water", "store", "food"), 15).otherwise(120)


def flat_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, at: Column | None = None) -> Column:
    """Flat metres, scaled at a latitude (by default the mean); longitudes go round the date line."""
    at = (lat1 + lat2) / 2 if at is None else at
    dx = (F.pmod(lon1 - lon2 + 180, F.lit(360.0)) - 180) * 111320 * F.cos(F.radians(at))
    return F.sqrt(dx * dx + F.pow((lat1 - lat2) * 111320, 2))


def family(kind: Column) -> Column:
    """Kinds that may match each other under one name."""
    return F.when(kind == "rock", "summit").otherwise(kind)


def keyed(df: DataFrame) -> DataFrame:
    """Records with usable positions, their name key and family."""
    return df.filter(usable(F.col("lon"), F.col("lat"))).withColumn("key", name_key(F.col("name"), F.col("kind"))).withColumn("family", family(F.col("kind")))


def _cells(df: DataFrame, spread: bool, step: float = STEP) -> DataFrame:
    """Rows with a cell; spread puts them in the 3 x 3 cells around (columns widen towards the poles)."""
    wide = F.lit(step) / F.greatest(F.cos(F.radians(F.floor(F.col("lat") / step) * step)), F.lit(0.05))
    if not spread:
        return df.withColumn("cy", F.floor(F.col("lat") / step)).withColumn("cx", F.floor(F.col("lon") / wide))
    d = F.array(F.lit(-1), F.lit(0), F.lit(1))
    df = df.withColumn("cy", F.explode(F.transform(d, lambda k: F.floor(F.col("lat") / step) + k)))
    row_wide = F.lit(step) / F.greatest(F.cos(F.radians(F.col("cy") * step)), F.lit(0.05))
    return df.withColumn("cx", F.explode(F.transform(d, lambda k: F.floor(F.col("lon") / row_wide) + k)))


def name_pairs(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of keyed records with one telling key, one family and cells that touch; with flat metres `m`."""
    side = lambda df, s: df.filter(~F.col("key").isin(*GENERIC)).select(
        "key", "family", "cx", "cy", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "kind", "lon", "lat", *columns))
    )
    # Not broadcast, whatever Spark takes the sides for: it doesn't count that b is spread over nine cells.
    pairs = side(_cells(a, False), "a").join(side(_cells(b, True), "b").hint("merge"), ["key", "family", "cx", "cy"])
    return pairs.withColumn("m", flat_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))).drop("cx", "cy")


def best_unless_close(pairs: DataFrame, of: str, gap_m: float = 30.0, other: str = "id_b") -> DataFrame:
    """The nearest partner of each record, unless a runner-up is less than gap_m farther; ties by id."""
    w = Window.partitionBy(of).orderBy("m", other)
    ranked = pairs.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("m").over(w))
    return ranked.filter((F.col("rank") == 1) & (F.col("next").isNull() | (F.col("next") - F.col("m") >= gap_m))).drop("rank", "next")


# -- nearest neighbours ------------------------------------------------------------------


def _nearest_in(points: pd.DataFrame, queries: pd.DataFrame, higher: bool) -> np.ndarray:
    """Angle from each query to its nearest point of another id (and of greater height)."""
    if not len(points) or not len(queries):
        return np.full(len(queries), np.inf)
    tree, at = VantageTree(unit_xyz(points["lon"], points["lat"])), unit_xyz(queries["lon"], queries["lat"])
    heights = (queries["h"].to_numpy(), points["h"].to_numpy()) if higher else ()
    return tree.nearest(at, queries["id"].to_numpy(), points["id"].to_numpy(), *heights)


def nearest_km(df: DataFrame, height: str | None = None, none_km: float = 20015.0) -> DataFrame:
    """(id, km) from each record to the nearest other one, or to the nearest one that is higher.

    Exact in two passes over a Voronoi partition: the nearest within a point's own cell bounds
    the search, and only points whose ball may reach another cell go there as queries. Cells are those of the
    radius join, parted again where they are overfull, and are searched by vantage-point trees.
    Ids must be distinct; records with an unusable position or no height are left out; a record without any
    such other gets none_km.
    """
    h = F.lit(0.0) if height is None else F.col(height).cast("double")
    pts = df.filter(usable(F.col("lon"), F.col("lat"))).select("id", F.col("lon").cast("double"), F.col("lat").cast("double"), h.alias("h")).filter("h is not null")
    pivots = _pivots(pts, pts.count())
    higher, kind = height is not None, pts.schema["id"].dataType.simpleString()
    if not len(pivots):
        return df.sparkSession.createDataFrame([], f"id {kind}, km double")
    placed = store(pts.mapInPandas(_assign(pivots, 0.0, False), _with_cell(pts.schema)))
    inner = _inner_pivots(placed, _counts(placed))
    if inner is not None:
        placed = store(placed.mapInPandas(_part_again(inner, 0.0, False), placed.schema))
    base = f"id {kind}, lon double, lat double, h double, cell int, inner int"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(bound=_nearest_in(pdf, pdf, higher))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = inner.value if inner is not None else {}
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                i, j = _reached(unit_xyz(part["lon"], part["lat"]), pivots, part["bound"].to_numpy()[:, None])
                out = part.iloc[i].assign(to=j.astype("int32"))
                for c, rows in out.groupby("to", sort=False):
                    if c in parts:
                        # The cell's rows may lie nearest to any of its pivots: the bound is on these alone.
                        k, m = _reached(unit_xyz(rows["lon"], rows["lat"]), parts[c], rows["bound"].to_numpy()[:, None])
                        rows = rows.iloc[k].assign(into=m.astype("int32"))
                    else:
                        rows = rows.assign(into=np.int32(0))
                    yield rows[(rows["to"] != rows["cell"]) | (rows["into"] != rows["inner"])].drop(columns=["cell", "inner"]).rename(columns={"to": "cell", "into": "inner"})[[*pdf.columns]]

    def second(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": y["id"], "bound": _nearest_in(x, y, higher)})

    keys = ["cell", "inner"]
    bounded = store(placed.groupBy(*keys).applyInPandas(first, base + ", bound double"))
    visits = bounded.mapInPandas(reach, bounded.schema)
    far = placed.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(second, f"id {kind}, bound double")
    best = bounded.select("id", "bound").unionByName(far).groupBy("id").agg(F.min("bound").alias("bound"))
    return best.select("id", F.when(F.col("bound") > 4, none_km).otherwise(F.col("bound") * (EARTH_M / 1000)).alias("km"))


def groups_within(df: DataFrame, key: list[str], metres: float) -> DataFrame:
    """(lead, id) of groups in which every member is within metres of every other, taken in id order.

    The order makes the outcome; rows with equal key are cut into runs of latitude farther apart than
    metres before they are folded, so that one key with many rows does not make one task.
    """
    w = Window.partitionBy(*key).orderBy("lat", "id")
    gap = F.col("lat") - F.lag("lat").over(w) > metres / 110_000
    run = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kind = df.schema["id"].dataType.simpleString()

    def fold_run(lon: np.ndarray, lat: np.ndarray) -> list[list[int]]:
        # Groups are looked up by the cell of their lead: a member lies in its cell or one beside it.
        size = metres * 1.01 / 111_320
        row = np.floor(lat / size).astype(int)
        wide = size / max(0.01, np.cos(np.radians(min(89.9, np.abs(lat).max() + size))))
        turn = int(np.ceil(360 / wide))
        column = np.floor((lon + 180) / wide).astype(int) % turn
        at: dict[tuple[int, int], list[int]] = {}
        groups: list[list[int]] = []
        for i in range(len(lon)):
            near = sorted(n for dy in (-1, 0, 1) for dx in {k % turn for k in (column[i] - 1, column[i], column[i] + 1, column[i] - 2, column[i] + 2)} for n in at.get((row[i] + dy, dx), ()))
            for n in near:
                g = groups[n]
                dx = ((lon[g] - lon[i] + 180) % 360 - 180) * 111320 * np.cos(np.radians((lat[g] + lat[i]) / 2))
                if (np.hypot(dx, (lat[g] - lat[i]) * 111320) <= metres).all():
                    g.append(i)
                    break
            else:
                at.setdefault((row[i], column[i]), []).append(len(groups))
                groups.append([i])
        return groups

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit", "id"], kind="stable")
        unit, lon, lat, ids = (pdf[c].to_numpy() for c in ("unit", "lon", "lat", "id"))
        edges = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
        lead, member = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            for g in fold_run(lon[a:b], lat[a:b]) if b - a > 1 else [[0]]:
                lead += [a + g[0]] * len(g)
                member += [a + i for i in g]
        return pd.DataFrame({"lead": ids[lead], "id": ids[member]})

    rows = df.filter(usable(F.col("lon"), F.col("lat"))).select(*key, "id", "lon", "lat").distinct().withColumn("run", run)
    # A run of a key is folded whole; many small ones go to one call.
    rows = store(rows.select(F.xxhash64(*key, "run").alias("unit"), "id", "lon", "lat"))
    calls = max(1, rows.count() // 20_000)
    return rows.groupBy(F.pmod("unit", F.lit(calls)).alias("call")).applyInPandas(fold, f"lead {kind}, id {kind}")
