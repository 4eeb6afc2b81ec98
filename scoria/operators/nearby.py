"""Points near other points or regions.

Radius join: a Voronoi partition around pivots. Every left point goes to its nearest
pivot's cell; every right point goes to each cell c with d(f, c) <= d(f, nearest) + 2r,
which the triangle inequality shows to be all that can hold a partner. Within a cell, a
vantage-point tree over the left points answers all right points by the exact
great-circle metric. Pivots are bounded samples of positions; a cell with too many rows is
parted again by pivots of its own, and one that these cannot part, as its rows share few places,
is cut into blocks of left x right points by a hash, so no task gets a whole hot spot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.geo import EARTH_M, angle, unit_xyz, usable
from ..session import small, store

ROWS_A_PIVOT = 6000
#: Pivots of the first level, and of one cell in the second: together 2048 * 512 places, 12 MB, however many rows there are.
MAX_PIVOTS, MAX_INNER = 2048, 512
BLOCK_ROWS = 60_000
LEAF = 48


class VantageTree:
    """A vantage-point tree over unit vectors that answers many queries at once."""

    def __init__(self, xyz: np.ndarray):
        self.xyz = xyz
        self.root = self._build(np.arange(len(xyz)))

    def _build(self, idx: np.ndarray):
        if len(idx) <= LEAF:
            return idx
        # The point farthest from the first one sees distances spread the most.
        vp = idx[np.argmax(angle(self.xyz[idx], self.xyz[idx[0]]))]
        d = angle(self.xyz[idx], self.xyz[vp])
        mid = len(idx) // 2
        order = np.argpartition(d, mid)
        near, far = order[:mid], order[mid:]
        if d[near].min() == d[far].max():  # all at one distance: nothing to part by
            return idx
        return vp, d[near].max(), d[far].min(), self._build(idx[near]), self._build(idx[far])

    def nearest(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, low: np.ndarray | None = None, height: np.ndarray | None = None) -> np.ndarray:
        """Angle from each query to the nearest point of another id, and with heights one that is higher; inf for none."""
        best = np.full(len(queries), np.inf)
        tops: dict[int, float] = {}

        def top(node) -> float:
            if height is None:
                return np.inf
            if id(node) not in tops:
                tops[id(node)] = max(height[node[0]], top(node[3]), top(node[4])) if isinstance(node, tuple) else float(height[node].max()) if len(node) else -np.inf
            return tops[id(node)]

        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            node, q, bound = todo.pop()
            open_ = bound < best[q]
            if low is not None:
                open_ &= low[q] < top(node)
            q = q[open_]
            if not len(q):
                continue
            if isinstance(node, tuple):
                vp, most, least, near, far = node
                d = angle(queries[q], self.xyz[vp])
                to_near, to_far = np.maximum(0, d - most), np.maximum(0, least - d)
                first = d <= (most + least) / 2
                for part, order in ((first, ((far, to_far), (near, to_near))), (~first, ((near, to_near), (far, to_far)))):
                    for child, reach in order:
                        todo.append((child, q[part], reach[part]))
                continue
            step = max(1, 2_000_000 // max(1, len(node)))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                d = angle(queries[part][:, None, :], self.xyz[node][None, :, :])
                d[ids[node][None, :] == own[part][:, None]] = np.inf
                if low is not None:
                    d[height[node][None, :] <= low[part][:, None]] = np.inf
                best[part] = np.minimum(best[part], d.min(1))
        return best

    def within(self, queries: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, point numbers) of all pairs within the radius, in parts."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if isinstance(node, tuple):
                vp, most, least, near, far = node
                d = angle(queries[q], self.xyz[vp])
                todo.append((near, q[d <= most + radius]))
                todo.append((far, q[d >= least - radius]))
                continue
            step = max(1, 2_000_000 // max(1, len(node)))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                hit = angle(queries[part][:, None, :], self.xyz[node][None, :, :]) <= radius
                i, j = np.nonzero(hit)
                yield part[i], node[j]


def _pivots(left: DataFrame, n: int) -> np.ndarray:
    """A bounded, deterministic sample of distinct positions: those with the least hashes."""
    k = int(min(MAX_PIVOTS, max(1, n // ROWS_A_PIVOT)))
    at = left.groupBy("lon", "lat").agg(F.xxhash64("lon", "lat").alias("h")).orderBy("h", "lon", "lat").limit(k)
    rows = at.select("lon", "lat").collect()
    return unit_xyz([r[0] for r in rows], [r[1] for r in rows]) if rows else np.zeros((0, 3))


def _nearest(xyz: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dots = xyz @ pivots.T
    return dots.argmax(1), dots


def _reached(xyz: np.ndarray, pivots: np.ndarray, radius) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, pivot numbers) of all cells that may hold a partner within a radius."""
    far = np.arccos(np.clip(xyz @ pivots.T, -1, 1))
    # 1e-6 rad (6 m) covers the rounding of arccos; more cells never lose a pair.
    return np.nonzero(far <= far.min(1, keepdims=True) + 2 * radius + 1e-6)


def _assign(pivots: np.ndarray, radius: float, spread: bool):
    """mapInPandas: rows with their cell; with spread, in every cell that may hold a partner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                xyz = unit_xyz(part["lon"], part["lat"])
                if spread:
                    i, j = _reached(xyz, pivots, radius)
                    yield part.iloc[i].assign(cell=j.astype("int32"), inner=np.int32(0))
                else:
                    yield part.assign(cell=_nearest(xyz, pivots)[0].astype("int32"), inner=np.int32(0))

    return run


def _part_again(inner, radius: float, spread: bool):
    """mapInPandas: rows of cells with pivots of their own, with the number of the inner cell, or of all that may hold a partner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = inner.value
        for pdf in batches:
            cells = pdf["cell"].to_numpy()
            for c in np.unique(cells):
                rows = np.flatnonzero(cells == c)
                for at in range(0, len(rows), 4096):
                    part = pdf.iloc[rows[at : at + 4096]]
                    if c not in own:
                        yield part
                        continue
                    xyz = unit_xyz(part["lon"], part["lat"])
                    if spread:
                        i, j = _reached(xyz, own[c], radius)
                        yield part.iloc[i].assign(inner=j.astype("int32"))
                    else:
                        yield part.assign(inner=_nearest(xyz, own[c])[0].astype("int32"))

    return run


def _with_cell(kind: StructType) -> StructType:
    return StructType([*kind.fields, StructField("cell", IntegerType()), StructField("inner", IntegerType())])


def _inner_pivots(placed: DataFrame, counts: dict[int, int]):
    """Pivots of the overfull cells: positions below a hash, so that no cell is sorted; a broadcast of bounded size."""
    spark = placed.sparkSession
    full = [(c, min(MAX_INNER, n // ROWS_A_PIVOT) / n) for c, n in counts.items() if n > BLOCK_ROWS]
    if not full:
        return None
    share = F.pmod(F.xxhash64("lon", "lat", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    at = placed.join(small(spark.createDataFrame(full, "cell int, share double")), "cell").filter(share < F.col("share")).select("cell", "lon", "lat").distinct()
    # Where positions are few, more of them may pass; the first of each cell are taken.
    per_cell: dict[int, list] = {}
    for r in at.orderBy("cell", F.xxhash64("lon", "lat")).limit(2 * MAX_PIVOTS * MAX_INNER).toLocalIterator():
        own = per_cell.setdefault(r["cell"], [])
        if len(own) < MAX_INNER:
            own.append((r["lon"], r["lat"]))
    return spark.sparkContext.broadcast({c: unit_xyz(*zip(*p)) for c, p in per_cell.items() if len(p) > 1})


def _counts(placed: DataFrame) -> dict[int, int]:
    """Rows of each cell of the first level: at most MAX_PIVOTS counts."""
    return {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}


def near_pairs(
    left: DataFrame, right: DataFrame, metres: float, left_id: str = "id", right_id: str = "id",
    names: tuple[str, str] = ("left_id", "right_id"),
) -> DataFrame:
    """Every pair of distinct ids with positions at most `metres` apart along the sphere.

    Both sides need their id column and `lon`, `lat`; other columns are not read. Rows
    with a null id or an unusable position (null, NaN, out of range, or 0, 0) are in no
    pair. Repeated rows and an id with several positions give a pair once. Empty sides
    give an empty result.
    """
    spark, radius = left.sparkSession, metres / EARTH_M
    a = left.select(F.col(left_id).alias("id"), F.col("lon").cast("double"), F.col("lat").cast("double"))
    b = right.select(F.col(right_id).alias("id"), F.col("lon").cast("double"), F.col("lat").cast("double"))
    a, b = (x.filter(usable(F.col("lon"), F.col("lat")) & F.col("id").isNotNull()) for x in (a, b))
    a_type, b_type = a.schema["id"].dataType, b.schema["id"].dataType
    out = StructType([StructField(names[0], a_type), StructField(names[1], b_type)])
    pivots = _pivots(a, a.count())
    if not len(pivots):
        return spark.createDataFrame([], out)
    # Both sides are stored with their cells, as they are counted and then joined.
    a = store(a.mapInPandas(_assign(pivots, radius, False), _with_cell(a.schema)))
    b = store(b.mapInPandas(_assign(pivots, radius, True), _with_cell(b.schema)))
    inner = _inner_pivots(a, _counts(a))
    if inner is not None:
        a = store(a.mapInPandas(_part_again(inner, radius, False), a.schema))
        b = store(b.mapInPandas(_part_again(inner, radius, True), b.schema))

    # Cells still overfull are cut into blocks; these are cells that no pivot parts, or beyond MAX_PIVOTS * MAX_INNER * BLOCK_ROWS rows.
    keys = ["cell", "inner"]
    over = lambda df, n: df.groupBy(*keys).count().filter(F.col("count") > BLOCK_ROWS).select(*keys, F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias(n))
    blocks = store(over(a, "na").join(over(b, "nb"), keys, "full").fillna(1, ["na", "nb"]))
    if blocks.isEmpty():
        a, b = (x.select(*keys, F.lit(0).alias("ba"), F.lit(0).alias("bb"), "id", "lon", "lat") for x in (a, b))
    else:
        one = lambda c: F.coalesce(c, F.lit(1))
        hashed = lambda n: F.pmod(F.xxhash64("id", "lon", "lat"), one(F.col(n))).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), one(F.col(n)) - 1))
        a = a.join(small(blocks), keys, "left").select(*keys, hashed("na").alias("ba"), every("nb").alias("bb"), "id", "lon", "lat")
        b = b.join(small(blocks), keys, "left").select(*keys, every("na").alias("ba"), hashed("nb").alias("bb"), "id", "lon", "lat")

    def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({names[0]: x["id"][:0], names[1]: y["id"][:0]})
        x, y = x.drop_duplicates(["id", "lon", "lat"]), y.drop_duplicates(["id", "lon", "lat"])
        # One tree point for each position; ids at it are expanded after the search.
        at = x.groupby(["lon", "lat"], sort=False).ngroup().to_numpy()
        first = np.unique(at, return_index=True)[1]
        tree = VantageTree(unit_xyz(x["lon"].to_numpy()[first], x["lat"].to_numpy()[first]))
        members = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[members], np.arange(len(first) + 1))
        ids_x, ids_y = x["id"].to_numpy(), y["id"].to_numpy()
        parts = []
        for q, p in tree.within(unit_xyz(y["lon"], y["lat"]), radius):
            n = starts[p + 1] - starts[p]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            parts.append(pd.DataFrame({names[0]: ids_x[members[np.repeat(starts[p], n) + offset]], names[1]: ids_y[np.repeat(q, n)]}))
        done = pd.concat(parts) if parts else pd.DataFrame({names[0]: ids_x[:0], names[1]: ids_y[:0]})
        return done.drop_duplicates()

    keys = [*keys, "ba", "bb"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(match, out).dropDuplicates()


def containing_regions(points: DataFrame, regions: DataFrame, step: float = 1.0) -> DataFrame:
    """Each point row with each region whose bounds hold it (closed bounds, as stored).

    Regions need `area_id, west, south, east, north`; they are spread over cells of `step`
    degrees, so the join is on the cell and the bounds are a residual. Points without a
    usable position and regions with a null or reversed bound are in no pair. Point columns
    keep their names; the region adds `area_id`, which must not be a point column.
    """
    lon, lat = F.col("lon"), F.col("lat")
    ok = ["west", "south", "east", "north"]
    cells = regions.filter(F.col("west") <= F.col("east")).filter(F.col("south") <= F.col("north")).select(
        F.col("area_id"), *(F.col(c).alias(f"r_{c}") for c in ok)
    )
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))
    cells = cells.withColumn("r_cx", F.explode(span("r_west", "r_east"))).withColumn("r_cy", F.explode(span("r_south", "r_north")))
    held = points.filter(usable(lon, lat)).join(
        small(cells),
        (F.floor(lon / step) == F.col("r_cx")) & (F.floor(lat / step) == F.col("r_cy"))
        & lon.between(F.col("r_west"), F.col("r_east")) & lat.between(F.col("r_south"), F.col("r_north")),
    )
    return held.select(*(points[c] for c in points.columns), "area_id")
