"""Map extracts as a Spark data source: one task for a run of blocks, elements as rows.

`spark.read.format("osm_extract").option("path", ...).load()` gives (elem_type, id, tags, lon, lat, refs, members).
The driver reads only the blocks' headers; with option filter=tagged, nodes without a tag are left out early, as
enrichment wants it.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "elem_type string, id bigint, tags map<string,string>, lon double, lat double, refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>"
_KINDS = ("node", "way", "relation")


def fields(blob: bytes):
    """(number, value) of a message: bytes for length-delimited fields, else whole numbers."""
    at, end = 0, len(blob)
    while at < end:
        tag, at = _varint(blob, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(blob, at)
        elif kind == 2:
            n, at = _varint(blob, at)
            value, at = blob[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = int.from_bytes(blob[at : at + n], "little"), at + n
        else:
            raise ValueError("a field of an unknown kind")
        yield tag >> 3, value


def _varint(blob: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = blob[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def numbers(blob: bytes, signed: bool = False, running: bool = False) -> list[int]:
    """A packed list; signed ones are zigzag, running ones are differences."""
    out, at, total = [], 0, 0
    while at < len(blob):
        v, at = _varint(blob, at)
        v = (v >> 1) ^ -(v & 1) if signed else v
        total = total + v if running else v
        out.append(total)
    return out


def _signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def block_rows(blob: bytes, tagged: bool):
    """Rows of one block of elements."""
    strings, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for n, v in fields(blob):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            grain = v
        elif n in (19, 20):
            v = v - (1 << 64) if v >> 63 else v
            lat0, lon0 = (v, lon0) if n == 19 else (lat0, v)
    place = lambda v, base: (base + grain * v) / 1e9
    for group in groups:
        for n, v in fields(group):
            if n == 2:
                yield from _dense(v, strings, place, lat0, lon0, tagged)
                continue
            m: dict = {}
            for k, x in fields(v):
                m[k] = x
            tags = {strings[a]: strings[b] for a, b in zip(numbers(m.get(2, b"")), numbers(m.get(3, b"")))}
            if n == 1 and (tags or not tagged):
                yield "node", _signed(m[1]), tags, place(_signed(m[9]), lon0), place(_signed(m[8]), lat0), None, None
            elif n == 3:
                yield "way", m[1], tags, None, None, numbers(m.get(8, b""), True, True), None
            elif n == 4:
                parts = zip(numbers(m.get(10, b"")), numbers(m.get(9, b""), True, True), numbers(m.get(8, b"")))
                yield "relation", m[1], tags, None, None, None, [(_KINDS[t], r, strings[s]) for t, r, s in parts]


def _dense(blob, strings, place, lat0, lon0, tagged):
    m = dict(fields(blob))
    pairs, at = numbers(m.get(10, b"")), 0
    for i, lat, lon in zip(*(numbers(m.get(k, b""), True, True) for k in (1, 8, 9))):
        tags = {}
        while at < len(pairs) and pairs[at]:
            tags[strings[pairs[at]]] = strings[pairs[at + 1]]
            at += 2
        at += 1
        if tags or not tagged:
            yield "node", i, tags, place(lon, lon0), place(lat, lat0), None, None


class Blocks(InputPartition):
    def __init__(self, places):
        self.places = places


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tagged = options["path"], options.get("filter") == "tagged"
        self.size = int(options.get("blocks", "16"))

    def partitions(self):
        places = []
        with open(self.path, "rb") as f:
            while head := f.read(4):
                m = dict(fields(f.read(struct.unpack(">I", head)[0])))
                if m[1] == b"OSMData":
                    places.append((f.tell(), m[3]))
                f.seek(m[3], 1)
        return [Blocks(places[i : i + self.size]) for i in range(0, len(places), self.size)] or [Blocks([])]

    def read(self, partition):
        with open(self.path, "rb") as f:
            for offset, size in partition.places:
                f.seek(offset)
                m = dict(fields(f.read(size)))
                if 1 not in m and 3 not in m:
                    raise ValueError("a block packed in an unknown way")
                yield from block_rows(m[1] if 1 in m else zlib.decompress(m[3]), self.tagged)


class Extract(DataSource):
    @classmethod
    def name(cls):
        return "osm_extract"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Extract)


def way_points(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways, rejects): ways with their points in order and whether they are closed; ways that lack a node, with the reason."""
    nodes = elements.filter("elem_type = 'node'").select(F.col("id").alias("ref"), "lon", "lat")
    ways = elements.filter("elem_type = 'way'").select("id", "tags", F.posexplode_outer("refs").alias("at", "ref"))
    full = ways.join(nodes, "ref", "left").groupBy("id").agg(
        F.first("tags").alias("tags"), F.array_sort(F.collect_list(F.struct("at", "ref", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"),
        F.count_if(F.col("lon").isNull()).alias("missing"),
    )
    points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    closed = (F.size("p") > 3) & (F.element_at("p", 1)["ref"] == F.element_at("p", -1)["ref"])
    ok = (F.col("missing") == 0) & (F.size("p") > 1)
    reason = F.when(F.size("p") < 2, "too few nodes").otherwise("nodes missing")
    return full.filter(ok).select("id", "tags", points.alias("points"), closed.alias("closed")), full.filter(~ok).select("id", reason.alias("reason"))


def regional_kind(tags: Column) -> Column:
    """Layer of an element's tags in the regional table, null for none; what stands first wins."""
    has = lambda k: tags[k].isNotNull()
    return (
        F.when(tags["natural"] == "coastline", "coastline").when(has("building"), "building").when(has("highway"), "road").when(has("railway"), "rail")
        .when(has("waterway"), "waterline").when(tags["natural"] == "water", "water").when(tags["natural"].isin("wood") | (tags["landuse"] == "forest"), "forest")
        .when(tags["natural"].isin("bare_rock", "scree", "cliff", "glacier"), "rock").when(tags["landuse"].isin("grass", "meadow", "farmland") | tags["natural"].isin("grassland", "scrub", "wetland"), "grass")
        .when(tags["landuse"].isin("residential", "commercial", "industrial"), "residential").when(has("place") & has("name"), "label")
    )
