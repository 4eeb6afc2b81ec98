"""Functions in SQL text against the column functions."""

from pyspark.sql import functions as F

from scoria.functions import mercator, sql
from scoria.functions.geo import haversine_m
from scoria.operators import grid


def test_sql_functions(spark):
    sql.register(spark)
    df = spark.createDataFrame([(-110.5, 40.25, -110.4, 40.3), (179.9, -85.5, -179.9, 89.0)], "a double, b double, c double, d double")
    df.createOrReplaceTempView("p")
    got = spark.sql("select world_x(a) x, world_y(b) y, inverse_lat(world_y(b)) l, tile_of(world_x(a), 10) t, haversine_m(a, b, c, d) m, flat_m(a, b, c, d) f, retry_after(3) r, from_terrarium(128, 1, 128) h from p").collect()
    want = df.select(mercator.world_x(F.col("a")).alias("x"), mercator.world_y(F.col("b")).alias("y"), mercator.tile_x(F.col("a"), 10).alias("t"), haversine_m(*(F.col(c) for c in "abcd")).alias("m")).collect()
    for g, w in zip(got, want):
        assert (g["x"], g["y"], g["t"], g["m"]) == (w["x"], w["y"], w["t"], w["m"]) and g["r"] == 240 and g["h"] == 1.5
    assert abs(got[0]["l"] - 40.25) < 1e-9 and abs(got[0]["f"] - got[0]["m"]) < 30
    assert "UDF" not in spark.sql("select haversine_m(a, b, c, d) from p")._jdf.queryExecution().optimizedPlan().toString()


def test_tile_cover(spark):
    sql.register(spark)
    boxes = spark.createDataFrame([(1, -110.0, 39.0, -108.0, 41.0), (2, -180.0, -90.0, 180.0, 90.0)], "i int, west double, south double, east double, north double")
    boxes.createOrReplaceTempView("b")
    got = {tuple(r) for r in spark.sql("select i, t.x, t.y from b, lateral tile_cover(6, west, south, east, north) t").collect()}
    assert got == {(r["i"], r["x"], r["y"]) for r in grid.cover(boxes, 6).collect()}
    assert spark.sql("select g_length(g_fromtext('LINESTRING(0 0, 3 4)')) l").first()["l"] == 5
