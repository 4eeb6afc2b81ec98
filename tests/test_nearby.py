"""Radius join against all pairs, in crowded and odd places."""

import numpy as np
import pytest

from scoria.functions.geo import EARTH_M, angle, unit_xyz
from scoria.operators import nearby
from scoria.operators.nearby import VantageTree, containing_regions, near_pairs


def all_pairs(a, b, metres):
    out = set()
    for i, x, y in a:
        for j, u, v in b:
            ok = all(q is not None and not np.isnan(q) for q in (x, y, u, v))
            ok = ok and all(-180 <= p <= 180 and -90 <= q <= 90 and (p, q) != (0, 0) for p, q in ((x, y), (u, v)))
            if ok and i is not None and j is not None and angle(unit_xyz([x], [y]), unit_xyz([u], [v]))[0] * EARTH_M <= metres:
                out.add((i, j))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, lon double, lat double")


def points(n, seed, tag):
    r = np.random.default_rng(seed)
    centres = [(-110, 40), (179.9999, 61), (-179.9999, 61), (20, 89.9995), (-70.5, -89.999), (0.0005, 0)]
    out = []
    for i in range(n):
        x, y = centres[i % len(centres)]
        x, y = x + r.normal(0, 0.002), y + r.normal(0, 0.0006)
        x = (x + 180) % 360 - 180
        out.append((f"{tag}{i}", float(x), float(np.clip(y, -90, 90))))
    return out


@pytest.mark.parametrize("block, pivots", [(60_000, 2048), (7, 2048), (20, 3)])
def test_like_all_pairs(spark, monkeypatch, block, pivots):
    """One level of cells; cells cut into blocks; and cells parted by pivots of their own."""
    monkeypatch.setattr(nearby, "ROWS_A_PIVOT", 20 if pivots > 3 else 5)
    monkeypatch.setattr(nearby, "BLOCK_ROWS", block)
    monkeypatch.setattr(nearby, "MAX_PIVOTS", pivots)
    odd = [("n1", None, 1.0), ("n2", 1.0, None), ("n3", 0.0, 0.0), ("n4", 181.0, 1.0), ("n5", 1.0, 91.0), ("n6", float("nan"), 1.0), (None, -110.0, 40.0)]
    a = points(240, 1, "a") + odd + [("same", -110.0, 40.0)] * 60 + [(f"s{i}", -110.0, 40.0) for i in range(30)]
    b = points(120, 2, "b") + odd + [("twice", -110.0, 40.0), ("twice", -110.0, 40.0), ("twice", -110.0001, 40.0)]
    got = near_pairs(frame(spark, a), frame(spark, b), 150.0).collect()
    assert len(got) == len(set(got))
    assert {(r[0], r[1]) for r in got} == all_pairs(a, b, 150.0)


def test_hot_spot_is_parted_not_copied(spark, monkeypatch):
    """Half of all rows near one place: pivots of its own part them, so that few rows are copied."""
    monkeypatch.setattr(nearby, "ROWS_A_PIVOT", 100)
    monkeypatch.setattr(nearby, "BLOCK_ROWS", 400)
    monkeypatch.setattr(nearby, "MAX_PIVOTS", 8)
    r = np.random.default_rng(4)
    rows = [(f"h{i}", -110 + r.uniform(0, 0.5), 40 + r.uniform(0, 0.5)) for i in range(6000)] + [(f"w{i}", r.uniform(-120, -80), r.uniform(30, 48)) for i in range(6000)]
    a = frame(spark, rows)
    pivots = nearby._pivots(a, len(rows))
    placed = a.mapInPandas(nearby._assign(pivots, 0.0, False), nearby._with_cell(a.schema)).cache()
    inner = nearby._inner_pivots(placed, nearby._counts(placed))
    own = placed.mapInPandas(nearby._part_again(inner, 0.0, False), placed.schema).groupBy("cell", "inner").count().collect()
    assert max(x["count"] for x in own) < 1000 and len(own) > 60
    to = a.mapInPandas(nearby._assign(pivots, 150 / EARTH_M, True), placed.schema).mapInPandas(nearby._part_again(inner, 150 / EARTH_M, True), placed.schema).count()
    assert to < 1.3 * len(rows)
    some = rows[::40]
    got = {tuple(x) for x in near_pairs(a, frame(spark, some), 150.0).collect()}
    assert got == all_pairs(rows, some, 150.0)


def test_nearest_like_brute_force(spark, monkeypatch):
    from scoria.operators.match import nearest_km

    r = np.random.default_rng(5)
    rows = [(f"p{i}", float(-110 + r.normal(0, 0.3)), float(40 + r.normal(0, 0.3)), float(r.integers(0, 50))) for i in range(700)] + [("x", None, 1.0, 1.0), ("far", 100.0, -40.0, 7.0)]
    df = spark.createDataFrame(rows, "id string, lon double, lat double, h double")
    good = [x for x in rows if x[1] is not None]
    xyz, h = unit_xyz([x[1] for x in good], [x[2] for x in good]), np.array([x[3] for x in good])
    d = angle(xyz[:, None, :], xyz[None, :, :]) * EARTH_M / 1000
    np.fill_diagonal(d, np.inf)
    up = np.where(h[None, :] > h[:, None], d, np.inf).min(1)
    for block, pivots in ((60_000, 2048), (40, 4)):
        monkeypatch.setattr(nearby, "ROWS_A_PIVOT", 50 if pivots > 4 else 10)
        monkeypatch.setattr(nearby, "BLOCK_ROWS", block)
        monkeypatch.setattr(nearby, "MAX_PIVOTS", pivots)
        got = {x["id"]: x["km"] for x in nearest_km(df).collect()}
        assert got == pytest.approx({x[0]: v for x, v in zip(good, d.min(1))})
        got = {x["id"]: x["km"] for x in nearest_km(df, "h").collect()}
        assert got == pytest.approx({x[0]: v if np.isfinite(v) else 20015.0 for x, v in zip(good, up)})


def test_empty_and_extra_columns(spark):
    a = frame(spark, [("a", 1.0, 1.0)])
    none = frame(spark, [])
    assert near_pairs(a, none, 150.0).count() == 0 and near_pairs(none, a, 150.0).count() == 0 and near_pairs(none, none, 150.0).count() == 0
    clash = a.selectExpr("id", "lon", "lat", "1 as cell", "5 as inner", "2 as ba", "3 as left_id", "4 as na")
    assert near_pairs(clash, clash, 10.0).collect() == [("a", "a")]


def test_tree_with_equal_points():
    xyz = unit_xyz([5.0] * 500 + [5.001], [7.0] * 501)
    q, p = zip(*VantageTree(xyz).within(unit_xyz([5.0], [7.0]), 50 / EARTH_M))
    assert sum(map(len, p)) == 500


def test_regions(spark):
    pts = spark.createDataFrame([("a", 1.5, 1.5), ("edge", 2.0, 2.0), ("out", 5.0, 5.0), ("bad", None, 1.0)], "id string, lon double, lat double")
    areas = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 1.0, 1.0, 3.0, 3.0), (3, None, 0.0, 9.0, 9.0), (4, 9.0, 0.0, 1.0, 9.0)], "area_id int, west double, south double, east double, north double")
    got = sorted((r["id"], r["area_id"]) for r in containing_regions(pts, areas).collect())
    assert got == [("a", 1), ("a", 2), ("edge", 1), ("edge", 2)]
    assert containing_regions(pts.limit(0), areas).count() == 0 and containing_regions(pts, areas.limit(0)).count() == 0
