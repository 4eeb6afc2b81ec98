"""The track accumulator: each rule, batch against one fold, stream against batch; components and canonical records."""

import random

import pandas as pd
from pyspark.sql import functions as F

from scoria.operators import canonical, match
from scoria.streaming.quota import take
from scoria.streaming.track import FIX, Track, stream_minute_counts, stream_track_stats, track_stats

NAMES = [c.split()[0] for c in FIX.split(", ")]


def walk(n, seed, device=1):
    r, rows, t, x = random.Random(seed), [], 1000, -120.0
    for k in range(n):
        t += r.choice([1000, 4000, 5000, 40_000]) if k % 11 == 0 else 4000
        x += r.choice([0.00005, 0.0002, 0.0003]) if k % 23 else 0.01
        rows.append((device, t, x, 38.0 + r.gauss(0, 1e-5), r.choice([None, 100.0 + r.gauss(0, 8)]), r.choice([5.0, 10.0, 60.0, None]), r.choice([5.0, 20.0, None]), k // 40))
    return rows


def plain(rows):
    t = Track()
    for row in sorted(rows, key=lambda f: f[1]):
        t.add(*row[1:])
    return round(t.distance, 6), round(t.moving_s, 6), round(t.gain, 6), t.points


def as_dict(rows):
    return {r["device"]: (round(r["distance"], 6), round(r["moving_s"], 6), round(r["gain"], 6), r["points"]) for r in rows}


def test_rules():
    def track(*fixes):
        t = Track()
        for f in fixes:
            t.add(*f)
        return t

    step = 0.0001  # about 8.8 m at this latitude
    assert track((0, 0.0, 38.0, None, 5, None, 0), (4000, step, 38.0, None, 5, None, 0)).moving_s == 4
    assert track((0, 0.0, 38.0, None, 5, None, 0), (4000, step, 38.0, None, 5, None, 1)).distance == 0  # a new segment
    assert track((0, 0.0, 38.0, None, 5, None, 0), (31_000, 3 * step, 38.0, None, 5, None, 0)).distance == 0  # a gap
    assert track((0, 0.0, 38.0, None, 5, None, 0), (400, step, 38.0, None, 5, None, 0)).distance == 0  # too fast
    assert track((0, 0.0, 38.0, None, 40, None, 0), (4000, step, 38.0, None, 40, None, 0)).distance == 0  # within the error
    assert track((0, 0.0, 38.0, None, 51, None, 0), (4000, step, 38.0, None, 5, None, 0)).distance == 0  # no anchor
    t = track((0, 0.0, 38.0, 100, 5, 5, 0), (4000, step, 38.0, 104, 5, 5, 0), (8000, 2 * step, 38.0, 106, 5, 5, 0), (12_000, 3 * step, 38.0, 99, 5, 16, 0))
    assert t.gain == 6 and t.height is None
    assert not track((1000, 0.0, 38.0, None, 5, None, 0)).add(1000, 1.0, 38.0, None, 5, None, 0)


def test_batch_is_one_fold(spark):
    rows = walk(300, 1) + walk(200, 2, 2)
    odd = [(1, 0, 0.0, 0.0, None, 5.0, None, 0), (1, 5, float("nan"), 0.0, None, 5.0, None, 0), (1, 5, 181.0, 0.0, None, 5.0, None, 0), (None, 5, 1.0, 1.0, None, 5.0, None, 0), (3, 5, 1.0, 1.0, None, None, None, 0)]
    got = as_dict(track_stats(spark.createDataFrame(rows + rows[:50] + odd, FIX)).collect())
    assert got[1] == plain(rows[:300]) and got[2] == plain(rows[300:]) and got[3] == (0, 0, 0, 1) and len(got) == 3
    assert track_stats(spark.createDataFrame([], FIX)).count() == 0


def test_stream_is_batch(spark, tmp_path):
    rows = walk(240, 3) + walk(240, 4, 2)
    order = sorted(rows, key=lambda r: r[1])
    for i in range(4):
        spark.createDataFrame(order[i * 120 : (i + 1) * 120] + (order[:30] if i == 2 else []), FIX).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    out = {}

    def keep(df, _):
        out.update(as_dict(df.collect()))

    for i in range(4):  # one file a batch, in order; the third brings late fixes
        pdf = spark.read.parquet(str(tmp_path / f"in/{i}"))
        pdf.coalesce(1).write.mode("append").parquet(str(tmp_path / "live"))
        s = stream_track_stats(spark.readStream.schema(pdf.schema).parquet(str(tmp_path / "live")))
        q = s.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert out == {1: plain(rows[:240]), 2: plain(rows[240:])}


def test_minutes(spark, tmp_path):
    pd.DataFrame({"role": ["a", "a", "b"], "ts": pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:59", "2024-01-01 00:01:00"])}).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "x.parquet")
    q = stream_minute_counts(spark.readStream.schema("role string, ts timestamp").parquet(str(tmp_path))).writeStream.format("memory").queryName("minutes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["role"], r["n"]) for r in spark.table("minutes").collect()) == [("a", 2), ("b", 1)]


def test_denied_uses_nothing():
    assert take([60, 50, 40, 1], 0, 100) == ([True, False, True, False], 100)


def test_components(spark):
    r = random.Random(9)
    chain = [(f"n{k:04}", f"n{k + 1:04}") for k in range(300)]
    r.shuffle(chain)
    ids = spark.createDataFrame([(f"n{k:04}",) for k in range(301)] + [("z1",), ("z2",)], "id string")
    got = {x["id"]: x["component"] for x in canonical.components(ids, spark.createDataFrame(chain, "a string, b string")).collect()}
    assert set(got.values()) == {"n0000", "z1", "z2"}


def test_canonical_records(spark):
    schema = "id string, name string, kind string, lon double, lat double, gnis_id string, match_ambiguous boolean, precedence int"
    step = 0.001  # 111 m
    rows = [
        ("nps:1", "Lost Lake Campground", "campground", -110.0, 40.0, None, False, 0), ("usfs:1", "Lost Lake", "campground", -110.0, 40.0 + step, "7", None, 1),
        ("gnis:7", "Other Name", "campground", -110.0, 40.02, "7", False, 3),  # joins by the id that nps:1 got from usfs:1
        ("gnis:8", "Lost Lake", "campground", -110.0, 40.0, "8", False, 3),  # another id: its own record
        ("a", "Foo", "summit", -100.0, 40.0, None, False, 0), ("b", "Foo", "summit", -100.0, 40.0 + 4 * step, None, False, 1), ("c", "Foo", "rock", -100.0, 40.0 + 2 * step, None, False, 2),  # between two: abstains
        ("d", "Spring", "spring", 5.0, 5.0, None, False, 0), ("e", "Spring", "spring", 5.0, 5.0, None, False, 1),
    ]
    got = {r["id"]: (r["canonical"], r["reason"]) for r in canonical.canonicalize(match.keyed(spark.createDataFrame(rows, schema)).withColumn("x", F.lit(1))).collect()}
    assert got == {
        "nps:1": ("nps:1", "new"), "usfs:1": ("nps:1", "name_kind_distance"), "gnis:7": ("nps:1", "gnis_id"), "gnis:8": ("gnis:8", "new"),
        "a": ("a", "new"), "b": ("b", "new"), "c": ("c", "new"), "d": ("d", "new"), "e": ("e", "new"),
    }


def test_canonical_records_are_not_broadcast(spark, monkeypatch):
    """Spark takes packed files for small and doesn't count that a row is spread over nine cells."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.sparkSession.createDataFrame(df.collect(), df.schema)

    monkeypatch.setattr(canonical, "store", kept)
    rows = [("a", "Foo", "summit", -100.0, 40.0, "7", False, 0), ("b", "Foo", "summit", -100.0, 40.001, "7", False, 1)]
    schema = "id string, name string, kind string, lon double, lat double, gnis_id string, match_ambiguous boolean, precedence int"
    out = canonical.canonicalize(match.keyed(spark.createDataFrame(rows, schema)))
    assert {tuple(r) for r in out.select("id", "canonical").collect()} == {("a", "a"), ("b", "a")}
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
