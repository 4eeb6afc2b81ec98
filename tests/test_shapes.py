"""Geometry kernels: conflation rules inside and outside each width, outlines, areas."""

from pyspark.sql import functions as F

from scoria.functions.geometry import g, register
from scoria.operators.shapes import conflate, dissolve, outlines

COLS = "cell int, id string, agency string, name string, class string, kind string, route_ref string, ref string, surface string, bridge boolean, tunnel boolean, reference boolean, wkt string, seq int"


def net(spark, *lines, canonical=False):
    register(spark)
    base = dict(cell=1, agency="OpenStreetMap", name="", route_ref="", ref="", surface="", bridge=False, tunnel=False, reference=False, kind="trail")
    base["class"] = "path"
    names = [c.split()[0] for c in COLS.split(", ")]
    rows = [tuple({**base, "seq": i, **x}[n] for n in names) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, COLS).withColumn("shape", g("FromText", F.col("wkt")))
    out = conflate(df, ["cell"], [F.col("seq")], canonical).select("id", "tied", "also", "class", g("Length", F.col("shape")).alias("l"), g("AsText", F.col("shape")).alias("w"))
    return [r.asDict() for r in out.collect()]


def total(rows, id_):
    return round(sum(r["l"] for r in rows if r["id"] == id_), 2)


REF = dict(id="r", reference=True, name="Ridge Trail", wkt="LINESTRING(0 0, 1000 0)")


def test_widths(spark):
    add = lambda y, **k: dict(id="a", agency="USFS", wkt=f"LINESTRING(0 {y}, 1000 {y})", **k)
    for name, inside, outside in (("Ridge Trl", 14, 16), ("Other", 2, 3), ("", 4, 6)):
        assert total(net(spark, REF, add(inside, name=name, kind="road")), "a") == 0, name
        assert total(net(spark, REF, add(outside, name=name, kind="road")), "a") == 1000, name
    assert total(net(spark, REF, add(14, name="Ridge Trail", bridge=True, kind="road")), "a") == 1000
    assert total(net(spark, REF, add(2, name="x", **{"class": "track"}, kind="road")), "a") == 1000


def test_reference_is_whole_and_portions_know_their_sources(spark):
    out = net(spark, REF, dict(id="a", agency="NPS", name="Ridge Trail", wkt="LINESTRING(200 5, 600 5)"))
    assert total(out, "r") == 1000 and total(out, "a") == 0
    along = [r for r in out if r["also"]]
    assert along and abs(sum(r["l"] for r in along) - 400) < 2 and along[0]["also"] == ["NPS:a"]


def test_crossing_stays_and_branch_is_tied(spark):
    out = net(spark, REF, dict(id="x", agency="NPS", name="Ridge Trail", wkt="LINESTRING(500 -200, 500 200)"))
    assert total(out, "x") == 400
    out = net(spark, REF, dict(id="b", agency="NPS", name="Ridge Trail", wkt="LINESTRING(0 6, 500 6, 500 400)"))
    tail = [r for r in out if r["id"] == "b"]
    assert len(tail) == 1 and tail[0]["tied"] and 370 < tail[0]["l"] < 405 and "500 0" in tail[0]["w"].replace(".0", "")


def test_wide_trail_needs_a_tight_stretch(spark):
    tight = dict(id="a", agency="USFS", name="Q", wkt="LINESTRING(0 1, 300 1, 340 40, 1000 40)")
    far = dict(id="a", agency="USFS", name="Q", wkt="LINESTRING(0 40, 1000 40)")
    assert total(net(spark, REF, tight), "a") < 50 and total(net(spark, REF, far), "a") == 1000
    other = {**tight, "ref": "12"}
    assert total(net(spark, {**REF, "ref": "7"}, other), "a") > 500


def test_main_route_only_gives_metadata(spark):
    pct = dict(id="p", agency="USFS", route_ref="PCT", name="Pacific Crest Trail", wkt="LINESTRING(0 300, 1000 300)")
    assert total(net(spark, REF, pct), "p") == 1000 and total(net(spark, REF, pct, canonical=True), "p") == 0
    assert total(net(spark, REF, {**pct, "name": "PCT Alternate"}, canonical=True), "p") == 1000


def test_pavement(spark):
    road = dict(id="r", reference=True, **{"class": "track"}, kind="", wkt="LINESTRING(0 0, 500 0)")
    out = net(spark, road, dict(id="f", agency="USFS", kind="forest_road", surface="AC - ASPHALT", **{"class": "track"}, wkt="LINESTRING(0 1, 500 1)"))
    assert {r["class"] for r in out if r["also"]} == {"unclassified"}


def test_order_and_cells_do_not_mix(spark):
    a, b = dict(id="a", agency="NPS", wkt="LINESTRING(0 500, 300 500)"), dict(id="b", agency="USFS", wkt="LINESTRING(0 501, 300 501)")
    assert total(net(spark, REF, a, b), "a") == 300 and total(net(spark, REF, a, b), "b") == 0
    assert total(net(spark, REF, {**b, "seq": 1}, {**a, "seq": 2}), "a") == 0
    assert total(net(spark, REF, a, {**b, "cell": 2}), "b") == 300


def test_source_junctions_are_kept(spark):
    """A branch met a survey that the reference replaces: it is led on to the reference, but only if they met."""
    main = dict(id="m", agency="NPS", name="Ridge Trail", wkt="LINESTRING(0 12, 500 12, 1000 12)")
    branch = dict(id="b", agency="NPS", name="Side", wkt="LINESTRING(500 12, 500 300)")
    assert abs(total(net(spark, REF, main, branch), "b") - 300) < 0.1
    apart = {**branch, "wkt": "LINESTRING(500 12.5, 500 300)"}
    assert abs(total(net(spark, REF, main, apart), "b") - 287.5) < 0.1
    assert abs(total(net(spark, REF, {**main, "bridge": False}, {**branch, "bridge": True}), "b") - 288) < 0.1


def test_odd_shapes(spark):
    out = net(spark, REF, dict(id="n", wkt=None), dict(id="e", wkt="LINESTRING EMPTY"), dict(id="bad", wkt="LINE(1"), dict(id="ring", agency="NPS", wkt="LINESTRING(0 900, 50 900, 50 950, 0 900)"))
    assert {r["id"] for r in out} == {"r", "ring"}


def test_outlines_once(spark):
    register(spark)
    rows = [(1, 1, "forest", "POLYGON((0 0, 10000 0, 10000 10000, 0 10000, 0 0))"), (1, 2, "park", "POLYGON((10000 0, 20000 0, 20000 10000, 10000 10000, 10000 0))"), (1, 3, "wilderness", "POLYGON((10002 0, 10002 500, 10010 500, 10010 0, 10002 0))")]
    df = spark.createDataFrame(rows, "cell int, area_id int, kind string, wkt string").withColumn("shape", g("FromText", F.col("wkt")))
    got = {r["area_id"]: r for r in outlines(df, ["cell"], 1.0).select("area_id", g("Length", F.col("stroke")).alias("l"), g("Area", F.col("shape")).alias("a")).collect()}
    assert got[2]["l"] == 40000 and 29400 < got[1]["l"] < 30000 and got[1]["a"] == 1e8 and got[3]["l"] < 1016


def strokes(spark, *areas):
    register(spark)
    df = spark.createDataFrame([(1, i, k, w) for i, (k, w) in enumerate(areas)], "cell int, area_id int, kind string, wkt string").withColumn("shape", g("FromText", F.col("wkt")))
    rows = outlines(df, ["cell"], 1.0).select("area_id", g("Length", F.col("stroke")).alias("l"), g("Area", F.col("shape")).alias("a")).collect()
    return {r["area_id"]: (round(r["l"], 1), r["a"]) for r in rows}


def rect(x0, y0, x1, y1):
    return f"POLYGON(({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


def test_shared_forest_edge(spark):
    left = ("forest", rect(0, 0, 5000, 9000))
    assert strokes(spark, left, ("forest", rect(5100, 0, 9000, 9000)))[1][0] == 25800.0  # areas that do not meet keep their strokes
    got = strokes(spark, left, ("forest", rect(4950, 0, 9000, 9000)))
    assert got[0][0] == 28000 and 16500 < got[1][0] < 18500 and got[1][1] == 4050 * 9000
    # Overlapping by more than the probes reach: the areas are not on opposite sides.
    assert 18100 < strokes(spark, left, ("forest", rect(100, 0, 5100, 9000)))[1][0] < 18300
    # A short contact is no shared edge.
    assert strokes(spark, left, ("forest", rect(5000, 8500, 9000, 9500)))[1][0] > 9400


def test_island_between_two_cuts(spark):
    """A bulge of some 500 m, up to 300 m away from the neighbour, between two shared runs is no stroke either; a higher one is."""
    bulge = "POLYGON((5000 0, 5000 3500, {0} 4000, {0} 4300, 5000 4800, 5000 9000, 9000 9000, 9000 0, 5000 0))"
    low, high = (strokes(spark, ("forest", rect(0, 0, 5000, 9000)), ("forest", bulge.format(x)))[1][0] for x in (5300, 5600))
    assert low < 17010 and high > 17300


def test_dissolve_in_salts(spark):
    register(spark)
    df = spark.range(200).selectExpr("id % 2 as k", "g_fromtext(concat('POLYGON((', id, ' 0,', id + 1, ' 0,', id + 1, ' 1,', id, ' 1,', id, ' 0))')) as shape")
    got = {r["k"]: (r["a"], r["n"]) for r in dissolve(df, ["k"]).select("k", g("Area", F.col("shape")).alias("a"), F.size(g("Polygons", F.col("shape"))).alias("n")).collect()}
    assert got == {0: (100.0, 100), 1: (100.0, 100)}


def test_within_is_exact(spark):
    """Length near another line against points every centimetre."""
    import math
    import random

    register(spark)
    r = random.Random(3)
    line = lambda n: [(r.uniform(0, 30), r.uniform(0, 30)) for _ in range(n)]

    def off(p, a, b, flat_a, flat_b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)
        if (t < 0 and flat_a) or (t > 1 and flat_b):
            return math.inf
        t = min(1, max(0, t))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    for _ in range(12):
        a, b, d, flat = line(3), line(4), r.choice([1.0, 3.0]), r.random() < 0.5
        text = lambda x: "LINESTRING(" + ", ".join(f"{u} {v}" for u, v in x) + ")"
        got = spark.createDataFrame([(text(a), text(b))], "a string, b string").select(g("WithinLength", g("FromText", F.col("a")), g("FromText", F.col("b")), d, flat)).first()[0]
        want, n = 0.0, 2000
        for p, q in zip(a, a[1:]):
            for k in range(n):
                at = (p[0] + (q[0] - p[0]) * (k + 0.5) / n, p[1] + (q[1] - p[1]) * (k + 0.5) / n)
                near = min(off(at, u, v, flat and i == 0, flat and i == len(b) - 2) for i, (u, v) in enumerate(zip(b, b[1:])))
                want += math.dist(p, q) / n * (near <= d)
        assert abs(got - want) < 0.1, (got, want, d, flat)


def test_signed_route_in_order(spark):
    """Lines of one route up to 100 m apart are one where their order agrees, however many points they have."""
    zig = ", ".join(f"{x} {80 if x % 50 else 70}" for x in range(0, 40001, 25))
    ref = dict(id="r", reference=True, route_ref="JMT", kind="trail", name="A", wkt="LINESTRING(0 0, 40000 0)")
    tight = f"LINESTRING(0 0, 30 1, 80 1, {', '.join(f'{x} {80 if x % 50 else 70}' for x in range(100, 40001, 25))})"
    add = dict(id="a", agency="USFS", route_ref="JMT", kind="trail", name="B")
    assert total(net(spark, ref, {**add, "wkt": tight}), "a") < 100
    assert total(net(spark, ref, {**add, "wkt": f"LINESTRING({zig})"}), "a") > 30000  # never near enough to begin with
    assert total(net(spark, ref, {**add, "route_ref": "PNT", "wkt": tight}), "a") > 30000
