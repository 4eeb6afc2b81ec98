"""Tile archives as a Spark data source: one lookup for each wanted (z, x, y), directories read once a task.

An archive is a file with a header of 127 bytes, directories of delta-coded entries, and tiles in Hilbert order.
`spark.read.format("tile_archive").option("path", ...).option("tiles", "z/x/y,...").load()` gives
(z, x, y, data), data null where the archive has no such tile.
"""

from __future__ import annotations

import gzip
import struct

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Largest tile that is unpacked, in bytes.
MOST = 64 << 20


def hilbert_id(z: int, x: int, y: int) -> int:
    """Number of a tile: all lower zooms first, then along the Hilbert curve."""
    d, n = 0, 1 << z
    s = n >> 1
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return ((1 << (2 * z)) - 1) // 3 + d


def varints(blob: bytes):
    value = shift = 0
    for byte in blob:
        value |= (byte & 127) << shift
        if byte & 128:
            shift += 7
        else:
            yield value
            value = shift = 0


def directory(blob: bytes) -> list[tuple[int, int, int, int]]:
    """Entries (first tile, run, length, offset); run 0 points to a further directory."""
    it = varints(blob)
    n = next(it)
    ids, at = [], 0
    for _ in range(n):
        at += next(it)
        ids.append(at)
    runs, lengths = [next(it) for _ in range(n)], [next(it) for _ in range(n)]
    offsets: list[int] = []
    for i in range(n):
        v = next(it)
        offsets.append(offsets[-1] + lengths[i - 1] if v == 0 and i else v - 1)
    return list(zip(ids, runs, lengths, offsets))


class Archive:
    def __init__(self, path: str):
        self.file = open(path, "rb")
        head = self.read(0, 127)
        if head[:7] != b"PMTiles" or head[7] != 3:
            raise ValueError("not a tile archive of version 3")
        (self.root, self.root_len, _, _, self.leaf, _, self.data, _) = struct.unpack("<8Q", head[8:72])
        self.inner, self.packed = head[97], head[98]
        self.known: dict[tuple[int, int], list] = {}

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        out = self.file.read(length)
        if len(out) != length:
            raise OSError("the archive ends early")
        return out

    def entries(self, offset: int, length: int):
        if (offset, length) not in self.known:
            blob = self.read(offset, length)
            self.known[offset, length] = directory(gzip.decompress(blob) if self.inner == 2 else blob)
        return self.known[offset, length]

    def get(self, z: int, x: int, y: int) -> bytes | None:
        want, offset, length = hilbert_id(z, x, y), self.root, self.root_len
        for _ in range(4):
            hit = None
            for e in self.entries(offset, length):
                if e[0] > want:
                    break
                hit = e
            if hit is None:
                return None
            first, run, size, at = hit
            if run:
                if want >= first + run:
                    return None
                blob = self.read(self.data + at, size)
                if self.packed == 2:
                    import zlib

                    pull = zlib.decompressobj(31)
                    blob = pull.decompress(blob, MOST)
                    if pull.unconsumed_tail:
                        raise ValueError("a tile is larger than allowed")
                return blob
            offset, length = self.leaf + at, size
        raise ValueError("directories are nested too deep")


class Part(InputPartition):
    def __init__(self, tiles):
        self.tiles = tiles


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.tiles = [tuple(map(int, t.split("/"))) for t in options["tiles"].split(",") if t]
        self.size = int(options.get("batch", "256"))

    def partitions(self):
        tiles = sorted(self.tiles, key=lambda t: hilbert_id(*t))
        return [Part(tiles[i : i + self.size]) for i in range(0, len(tiles), self.size)] or [Part([])]

    def read(self, partition):
        archive = Archive(self.path) if partition.tiles else None
        for t in partition.tiles:
            yield (*t, archive.get(*t))


class TileArchive(DataSource):
    @classmethod
    def name(cls):
        return "tile_archive"

    def schema(self):
        return "z int, x int, y int, data binary"

    def reader(self, schema):
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileArchive)
