"""Readers and sinks over small files."""

import gzip
import json
import struct

import numpy as np
import pytest

from scoria.sources import archive, readers, tiles


def test_gnis(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("feature_id|feature_name|feature_class|state_name|prim_lat_dec|prim_long_dec\n1|Foo Peak|Summit|X|40.5|-110.5\n2|Bar (historical)|Spring|X|40|-110\n3|Baz|School|X|40|-110\n4|Qux|Falls|X|0|0\n5|Quux|Falls|X|n/a|-110\n")
    rows = readers.gnis_points(readers.read_gnis(spark, str(p))).collect()
    assert [(r["id"], r["kind"], r["min_zoom"], r["lon"]) for r in rows] == [("gnis:1", "summit", 13, -110.5)]
    (tmp_path / "bad.txt").write_text("a|b\n1|2\n")
    with pytest.raises(ValueError, match="missing"):
        readers.read_gnis(spark, str(tmp_path / "bad.txt"))


def test_geonames(spark, tmp_path):
    row = lambda i, name, lat, lon, c, code, country="US", el="": "\t".join([str(i), name, name, "", str(lat), str(lon), c, code, country, "", "CA", "", "", "", "0", el, "9", "tz", "2020-01-01"])
    p = tmp_path / "n.txt"
    p.write_text("\n".join([row(1, 'Say "Foo', 40, -110, "T", "PK", el="3000"), row(2, "B", 40, -110, "P", "PPL"), row(3, "C", 40, -110, "H", "SPNT"), row(4, "D", 40, -110, "T", "MT", "CA")]) + "\n")
    got = {r["id"]: r for r in readers.geonames_points(readers.read_geonames(spark, str(p))).collect()}
    assert set(got) == {"geonames:1", "geonames:3"} and got["geonames:1"]["elevation_m"] == 3000 and got["geonames:1"]["name"] == 'Say "Foo' and got["geonames:3"]["spring_type"] == "hot"
    p.write_text("1\tonly\tthree\n")
    with pytest.raises(Exception):
        readers.geonames_points(readers.read_geonames(spark, str(p))).collect()


def test_facilities_and_poly(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text('FacilityID,FacilityName,FacilityTypeDescription,FacilityLongitude,FacilityLatitude,Enabled\n1,"A ""big"", camp",Campground,-110,40,true\n2,B,Campground,-110,40,false\n3,C,Campground,,,true\n')
    assert [(r["id"], r["name"]) for r in readers.read_facilities(spark, str(p)).collect()] == [("ridb:1", 'A "big", camp')]
    p = tmp_path / "r.poly"
    p.write_text("region\n1\n  0 0\n  1.0E+00 0\n  1 1\nEND\n!2\n 0.1 0.1\n 0.2 0.1\n 0.2 0.2\nEND\nEND\n")
    got = sorted((r["ring"], r["hole"], len(r["points"])) for r in readers.read_poly(spark, str(p)).collect())
    assert got == [(0, False, 3), (1, True, 3)]


def test_geojson_and_fixes(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"id": "a", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"name": "x"}}]}
    with gzip.open(tmp_path / "a.geojson.gz", "wt") as f:
        json.dump(doc, f)
    r = readers.read_geojson(spark, str(tmp_path / "a.geojson.gz"), "name string").first()
    assert (r["id"], r["type"], json.loads(r["coordinates"]), r["properties"]["name"]) == ("a", "Point", [1.5, 2], "x")
    (tmp_path / "t.jsonl").write_text('{"x":1,"y":2,"z":null,"time":5,"segment":0}\n{"x":1,"y"\n{"x":1,"y":2,"time":6,"segment":1}\n{"y":2}\n')
    good, bad = readers.read_fixes(spark, str(tmp_path / "t.jsonl"))
    assert good.count() == 2 and bad.count() == 2


def make_archive(path, entries):
    def varint(n):
        return tiles._varint(n)

    items, data, offset = [], b"", 0
    for key, blob in sorted(entries.items(), key=lambda kv: archive.hilbert_id(*kv[0])):
        z = gzip.compress(blob)
        items.append((archive.hilbert_id(*key), len(z), offset))
        data, offset = data + z, offset + len(z)
    d, last = varint(len(items)), 0
    for i, _, _ in items:
        d, last = d + varint(i - last), i
    d += b"".join(varint(1) for _ in items) + b"".join(varint(n) for _, n, _ in items) + b"".join(varint(o + 1) for _, _, o in items)
    d = gzip.compress(d)
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(d), 0, 0, 0, 0, 127 + len(d), len(data)) + b"\0" * 25 + bytes([2, 2]) + b"\0" * 28
    path.write_bytes(head + d + data)


def test_archive(spark, tmp_path):
    assert [archive.hilbert_id(*t) for t in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0))] == [0, 1, 2, 3, 4, 5]
    make_archive(tmp_path / "a.pmtiles", {(0, 0, 0): b"root", (3, 4, 5): b"deep", (3, 7, 0): b"edge"})
    archive.register(spark)
    df = spark.read.format("tile_archive").option("path", str(tmp_path / "a.pmtiles")).option("tiles", "0/0/0,3/4/5,3/7/0,3/0/0").option("batch", "2").load()
    got = {(r["z"], r["x"], r["y"]): r["data"] and bytes(r["data"]) for r in df.collect()}
    assert got == {(0, 0, 0): b"root", (3, 4, 5): b"deep", (3, 7, 0): b"edge", (3, 0, 0): None}


def read_fields(blob):
    at, out = 0, []

    def varint():
        nonlocal at
        v = s = 0
        while True:
            b = blob[at]
            at += 1
            v |= (b & 127) << s
            if not b & 128:
                return v
            s += 7

    while at < len(blob):
        tag = varint()
        if tag & 7 == 2:
            n = varint()
            out.append((tag >> 3, blob[at : at + n]))
            at += n
        elif tag & 7 == 1:
            out.append((tag >> 3, blob[at : at + 8]))
            at += 8
        else:
            out.append((tag >> 3, varint()))
    return out


def test_vector_tile():
    square = [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25)]
    blob = tiles.encode_tile({"a": [(7, 3, [square], {"k": "v", "n": 3, "f": 1.5, "b": True, "skip": None}), (8, 2, [[(0, 0), (0, 0)]], {})], "none": []}, (0, 0, 1, 1))
    layers = [read_fields(v) for n, v in read_fields(blob) if n == 3]
    assert len(layers) == 1
    layer = dict(layers[0])
    features = [dict(read_fields(v)) for n, v in layers[0] if n == 2]
    assert layer[1] == b"a" and layer[5] == 4096 and layer[15] == 2 and len(features) == 1 and features[0][1] == 7 and features[0][3] == 3
    assert sum(n == 3 for n, _ in layers[0]) == 4 and sum(n == 4 for n, _ in layers[0]) == 4
    assert tiles.packed(blob) == tiles.packed(blob)


def test_terrarium_image():
    h = np.array([[-32768.0, 0, 1.25], [8848.86, -86.0, 65535]])
    back = tiles.read_terrarium_png(tiles.terrarium_png(h))
    assert np.abs(back - np.clip(h, -32768, 32767.996)).max() <= 1 / 256
    with pytest.raises(ValueError):
        tiles.terrarium_png(np.array([[np.nan]]))


def test_publication(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id * 2 as v")
    a = tiles.publish(df, str(tmp_path), "r1")
    assert tiles.publish(df, str(tmp_path), "r1") == a and json.loads((tmp_path / "current.json").read_text())["version"] == "r1"
    with pytest.raises(ValueError, match="other contents"):
        tiles.publish(spark.range(99).selectExpr("id", "id * 2 as v"), str(tmp_path), "r1")
    assert json.loads((tmp_path / "current.json").read_text())["rows"] == 100


def zig(n):
    return tiles._varint(tiles._zigzag(n))


def diffs(values):
    return b"".join(zig(b - a) for a, b in zip([0, *values], values))


def test_extract(spark, tmp_path):
    from scoria.sources import extract

    v, f = tiles._varint, tiles._field
    words = [b"", b"name", b"A", b"highway", b"path", b"outer", b"natural", b"peak"]
    table = f(1, b"".join(f(1, w) for w in words))
    dense = f(2, f(1, diffs([10, 11, 12])) + f(8, diffs([400000000, 400010000, 400020000])) + f(9, diffs([-1100000000, -1100010000, -1100020000])) + f(10, v(1) + v(2) + v(0) + v(0) + v(6) + v(7) + v(0)))
    way = lambda i, refs: f(3, v(1 << 3) + v(i) + f(2, v(3)) + f(3, v(4)) + f(8, diffs(refs)))
    relation = f(4, v(1 << 3) + v(7) + f(8, v(5)) + f(9, diffs([5])) + f(10, v(1)))
    blocks = [table + f(2, dense), table + f(2, way(5, [10, 11, 12, 10])) + f(2, way(6, [10, 99])) + f(2, way(8, [10])) + f(2, relation)]
    out = b""
    for kind, raw in [(b"OSMHeader", b""), *((b"OSMData", b) for b in blocks)]:
        blob = f(3, __import__("zlib").compress(raw)) if raw else f(1, raw)
        head = f(1, kind) + v(3 << 3) + v(len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    (tmp_path / "x.pbf").write_bytes(out)
    extract.register(spark)
    df = spark.read.format("osm_extract").option("path", str(tmp_path / "x.pbf")).option("blocks", "1").load()
    rows = {(r["elem_type"], r["id"]): r for r in df.collect()}
    assert len(rows) == 7 and rows["node", 10]["tags"] == {"name": "A"} and rows["node", 11]["tags"] == {} and rows["node", 12]["tags"] == {"natural": "peak"}
    assert abs(rows["node", 11]["lon"] + 110.001) < 1e-9 and abs(rows["node", 11]["lat"] - 40.001) < 1e-9
    assert rows["way", 5]["refs"] == [10, 11, 12, 10] and rows["way", 5]["tags"] == {"highway": "path"} and tuple(rows["relation", 7]["members"][0]) == ("way", 5, "outer")
    tagged = spark.read.format("osm_extract").option("path", str(tmp_path / "x.pbf")).option("filter", "tagged").load()
    assert tagged.filter("elem_type = 'node'").count() == 2
    ways, bad = extract.way_points(df)
    w = ways.withColumn("kind", extract.regional_kind(ways["tags"])).collect()
    assert [(r["id"], r["closed"], len(r["points"]), r["kind"]) for r in w] == [(5, True, 4, "road")]
    assert sorted(map(tuple, bad.collect())) == [(6, "nodes missing"), (8, "too few nodes")]
