"""Operators on geometries: dissolving, conflating cells of lines, and outlines drawn once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import g, register

LINE_COLUMNS = ("id", "agency", "name", "class", "kind", "route_ref", "ref", "surface", "bridge", "tunnel", "reference", "shape")


def dissolve(df: DataFrame, key: list[str], shape: str = "shape", salts: int = 32) -> DataFrame:
    """(key, shape): the union of each group's shapes, first within salts of it, then of those.

    No task holds a whole large group: a salt has its share of the shapes, and the second step at most `salts`.
    """
    register(df.sparkSession)
    part = df.withColumn("_salt", F.pmod(F.xxhash64(shape), F.lit(salts))).groupBy(*key, "_salt").agg(g("Union", F.collect_list(shape)).alias(shape))
    return part.groupBy(*key).agg(g("Union", F.collect_list(shape)).alias(shape))


def pairs_of_groups(lines: DataFrame, key: list[str], source: str) -> DataFrame:
    """(key, source_a, source_b, shape_a, shape_b): each key's lines of two sources, each source's dissolved into one shape."""
    d = dissolve(lines, [*key, source])
    side = lambda s: d.select(*key, F.col(source).alias(f"{source}_{s}"), F.col("shape").alias(f"shape_{s}"))
    return side("a").join(side("b"), key).filter(F.col(f"{source}_a") < F.col(f"{source}_b"))


def overlaps(lines: DataFrame, key: list[str], source: str, metres: float = 50.0, least: float = 100.0, share: float = 0.5) -> DataFrame:
    """(key, source_a, source_b, shared, ratio) of sources that draw the same ways under one key.

    `shared` is the lesser of both lengths within `metres` of the other, ends cut flat; kept are pairs that share `least` and
    a `share` of the shorter one.
    """
    near = lambda p, q: g("WithinLength", F.col(f"shape_{p}"), F.col(f"shape_{q}"), metres, True)
    p = pairs_of_groups(lines, key, source).withColumn("shared", F.least(near("a", "b"), near("b", "a")))
    shorter = F.greatest(F.least(g("Length", F.col("shape_a")), g("Length", F.col("shape_b"))), F.lit(1.0))
    p = p.withColumn("ratio", F.col("shared") / shorter).filter((F.col("shared") >= least) & (F.col("ratio") >= share))
    return p.select(*key, f"{source}_a", f"{source}_b", "shared", "ratio")


def coverage(lines: DataFrame, key: list[str], source: str, widths: tuple[float, ...] = (15.0, 30.0, 50.0)) -> DataFrame:
    """(key, source_a, source_b, a15, ..., b50): of each of two sources' lines under one key, the share within each width of the other's."""
    p = pairs_of_groups(lines, key, source)
    part = lambda x, y, d: g("WithinLength", F.col(f"shape_{x}"), F.col(f"shape_{y}"), d, False) / F.greatest(g("Length", F.col(f"shape_{x}")), F.lit(1.0))
    return p.select(*key, f"{source}_a", f"{source}_b", *(part(x, y, d).alias(f"{x}{d:.0f}") for x, y in ("ab", "ba") for d in widths))


def merge_parts(df: DataFrame, key: list[str], shape: str = "shape") -> DataFrame:
    """(key, part): each group's lines joined end to end, one row for each resulting line."""
    register(df.sparkSession)
    return df.groupBy(*key).agg(g("MergeLines", F.collect_list(shape)).alias("m")).select(*key, F.explode(g("Lines", F.col("m"))).alias("part"))


def conflate(lines: DataFrame, cell: list[str], order: list[Column], canonical: bool = False) -> DataFrame:
    """Portions of one network for each cell: (cell, id, agency, class, tied, also, shape).

    `lines` has LINE_COLUMNS in local metres; references are kept as they are, additions come in
    order, lose what lies along lines already there and are tied to them where they were cut. `also` names the
    additions found along a portion. A cell is bounded by its ground and halo; the fold over it is sequential by nature.
    """
    register(lines.sparkSession)
    row = F.struct(*(F.col(c) for c in LINE_COLUMNS))
    first = F.struct(F.row_number().over(Window.partitionBy(*cell).orderBy(*order)).alias("at"), row.alias("row"))
    cells = lines.withColumn("_x", first).groupBy(*cell).agg(F.array_sort(F.collect_list("_x")).alias("rows"))
    portions = g("Conflate", F.transform("rows", lambda x: x["row"]), canonical)
    return cells.select(*cell, F.explode(portions).alias("p")).select(*cell, "p.*")


# Which designation is drawn before which.
OUTLINE_ORDER = {"park": 0, "wilderness": 1, "forest": 2}


def outlines(areas: DataFrame, cell: list[str], unit: float) -> DataFrame:
    """(cell, area_id, kind, stroke, shape): strokes of a cell's areas, each edge drawn once; shapes unaltered.

    Parks come first, then wildernesses, then forests; a stroke leaves out what earlier ones show, and a forest's also its
    runs beside parks and the edges that it shares with earlier forests. `areas` has
    area_id, kind and shape; `unit` is one metre in the shapes' units. The fold runs over a cell's own areas only.
    """
    register(areas.sparkSession)
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in OUTLINE_ORDER.items() for x in kv))[F.col("kind")], F.lit(3))
    row = F.struct(rank.alias("rank"), F.col("area_id"), F.col("kind"), F.col("shape"), g("Boundary", F.col("shape")).alias("edge"))
    cells = areas.groupBy(*cell).agg(F.array_sort(F.collect_list(row)).alias("a"))
    at = cells.select(*cell, "a", F.posexplode("a").alias("_i", "_x"))
    earlier = F.transform(F.slice("a", F.lit(1), F.col("_i")), lambda x: F.struct(x["kind"].alias("kind"), x["shape"].alias("shape"), x["edge"].alias("edge")))
    stroke = g("Outline", F.col("_x.kind"), F.col("_x.shape"), F.col("_x.edge"), earlier, unit)
    return at.select(*cell, "_x.area_id", "_x.kind", stroke.alias("stroke"), "_x.shape")
