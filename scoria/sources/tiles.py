"""Sinks: vector tiles, elevation images, and directories published by a pointer."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENT = 4096


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _value(v) -> bytes:
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, int):
        return _varint(6 << 3) + _varint(_zigzag(v))
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


def quantize(points, bounds, extent: int = EXTENT) -> list[tuple[int, int]]:
    """Whole tile coordinates, y down, half to even, without repeats in a row."""
    w, s, e, n = bounds
    xy = np.rint(np.column_stack([(np.array([p[0] for p in points]) - w) / (e - w) * extent, (n - np.array([p[1] for p in points])) / (n - s) * extent])).astype(int)
    out: list[tuple[int, int]] = []
    for x, y in xy.tolist():
        if not out or out[-1] != (x, y):
            out.append((x, y))
    return out


def commands(kind: int, parts: list[list[tuple[int, int]]]) -> bytes:
    """Drawing commands of points (1), lines (2) or rings (3); rings go round the right way, outer first."""
    out, at = bytearray(), (0, 0)
    for i, part in enumerate(parts):
        if kind == 3:
            if part[0] == part[-1]:
                part = part[:-1]
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(part, part[1:] + part[:1]))
            if len(part) < 3 or area == 0:
                continue
            if (area > 0) != (i == 0):
                part = part[::-1]
        elif kind == 2 and len(part) < 2:
            continue
        for k, p in enumerate(part):
            if k == 0:
                out += _varint(1 | 1 << 3)
            elif k == 1:
                out += _varint(2 | (len(part) - 1) << 3)
            out += _varint(_zigzag(p[0] - at[0])) + _varint(_zigzag(p[1] - at[1]))
            at = p
        if kind == 3:
            out += _varint(7 | 1 << 3)
    return bytes(out)


def encode_layer(name: str, features: list[tuple[int, int, list, dict]], bounds, extent: int = EXTENT) -> bytes:
    """A layer of (id, kind, parts of points, properties)."""
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    body = bytearray()
    for ident, kind, parts, props in features:
        geometry = commands(kind, [quantize(p, bounds, extent) for p in parts if p])
        if not geometry:
            continue
        tags = b"".join(
            _varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault((type(v).__name__, v), len(values)))
            for k, v in props.items() if isinstance(v, (str, int, float, bool))
        )
        body += _field(2, _varint(1 << 3) + _varint(ident) + _field(2, tags) + _varint(3 << 3) + _varint(kind) + _field(4, geometry))
    out = _varint(15 << 3) + _varint(2) + _field(1, name.encode()) + bytes(body)
    out += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values)
    return out + _varint(5 << 3) + _varint(extent)


def encode_tile(layers: dict[str, list], bounds, extent: int = EXTENT) -> bytes:
    return b"".join(_field(3, encode_layer(n, f, bounds, extent)) for n, f in layers.items() if f)


def packed(blob: bytes, level: int = 6) -> tuple[bytes, str]:
    """Gzip without a time stamp, and its SHA-256."""
    out = gzip.compress(blob, level, mtime=0)
    return out, hashlib.sha256(out).hexdigest()


def point_tiles(df: DataFrame, layer: str, columns: list[str]) -> DataFrame:
    """(z, x, y, data, sha) of point rows with z, x, y, id (number), wx, wy in 0..1; one tile is bounded by thinning."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z, x, y = (int(pdf[c].iloc[0]) for c in ("z", "x", "y"))
        n = 1 << z
        rows = pdf.sort_values("id")
        feats = [(int(r["id"]), 1, [[(r["wx"], 1 - r["wy"])]], {c: r[c] for c in columns if r[c] is not None and r[c] == r[c]}) for r in rows.to_dict("records")]
        blob, sha = packed(encode_tile({layer: feats}, (x / n, 1 - (y + 1) / n, (x + 1) / n, 1 - y / n)))
        return pd.DataFrame([(z, x, y, blob, sha)], columns=["z", "x", "y", "data", "sha"])

    return df.select("z", "x", "y", "id", "wx", "wy", *columns).groupBy("z", "x", "y").applyInPandas(one, "z int, x bigint, y bigint, data binary, sha string")


def terrarium_png(heights: np.ndarray, level: int = 6) -> bytes:
    """A lossless image of elevations, a 256th of a metre a step; not-a-number is refused."""
    if not np.isfinite(heights).all():
        raise ValueError("elevations are missing")
    n = np.rint(np.clip(heights.astype(float) + 32768, 0, 65535.996) * 256).astype(np.int64)
    rgb = np.stack([n >> 16 & 255, n >> 8 & 255, n & 255], -1).astype(np.uint8)
    h, w = heights.shape
    raw = b"".join(b"\0" + rgb[i].tobytes() for i in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def read_terrarium_png(blob: bytes) -> np.ndarray:
    """The elevations of such an image (no other filters than those written here)."""
    at, data, size = 8, b"", None
    while at < len(blob):
        n, kind = struct.unpack(">I4s", blob[at : at + 8])
        if kind == b"IHDR":
            size = struct.unpack(">II", blob[at + 8 : at + 16])
        elif kind == b"IDAT":
            data += blob[at + 8 : at + 8 + n]
        at += 12 + n
    w, h = size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + 3 * w)
    if rows[:, 0].any():
        raise ValueError("an image with row filters")
    rgb = rows[:, 1:].reshape(h, w, 3).astype(float)
    return rgb[..., 0] * 256 + rgb[..., 1] + rgb[..., 2] / 256 - 32768


def _files(spark, root: str):
    """The JVM, the file system of a folder or address, and its places by name."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.getFileSystem(conf).makeQualified(folder).toUri(), conf)
    return jvm, files, lambda name: files.makeQualified(jvm.org.apache.hadoop.fs.Path(folder, name))


def current(spark, root: str) -> DataFrame:
    """The version that the pointer names."""
    version = json.loads(spark.read.text(f"{root}/current.json", wholetext=True).first()["value"])["version"]
    return spark.read.parquet(f"{root}/{version}")


def publish(df: DataFrame, root: str, version: str) -> dict:
    """Write a version's files, verify them by reading back, then move the pointer: readers see all or nothing.

    A version is immutable: the same name with other contents is refused. `root` is a folder or address that driver and
    executors share.
    """
    path = f"{root}/{version}"
    digest = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h") % 1_000_003), F.lit(0)).alias("sum")).first().asDict()
    jvm, files, at = _files(df.sparkSession, root)
    if not files.util().exists(at(f"{version}/_SUCCESS")):
        df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    again = back.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h") % 1_000_003), F.lit(0)).alias("sum")).first().asDict()
    if again != digest:
        raise ValueError(f"{version} holds other contents")
    pointer = json.dumps({"version": version, **digest}, sort_keys=True).encode()
    flags, over = jvm.java.util.EnumSet, jvm.org.apache.hadoop.fs.CreateFlag
    out = files.create(at("current.json.part"), flags.of(over.CREATE, over.OVERWRITE), df.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(pointer)
    out.close()
    moves = df.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    moves[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(at("current.json.part"), at("current.json"), moves)
    return digest
