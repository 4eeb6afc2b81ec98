"""Readers of the source formats: explicit schemas, failures never turned into empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import classify

GEONAMES = "geonameid string, name string, asciiname string, alternates string, lat double, lon double, class string, code string, country string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population bigint, elevation double, dem int, tz string, modified string"
# Gazetteer codes kept, by the GNIS class that they stand for.
GEONAMES_CLASS = {"T.MT": "Summit", "T.PK": "Summit", "T.HLL": "Summit", "T.PASS": "Gap", "T.GAP": "Gap", "T.SDL": "Gap", "H.SPNG": "Spring", "H.SPNT": "Spring", "H.SPNS": "Spring", "H.FLLS": "Falls", "S.CAVE": "Cave", "T.RK": "Pillar"}


def read_gnis(spark: SparkSession, path: str) -> DataFrame:
    """A pipe-delimited gazetteer with a header that must hold the needed columns; other columns stay texts."""
    df = spark.read.csv(path, sep="|", header=True, multiLine=False, mode="FAILFAST")
    missing = {"feature_id", "feature_name", "feature_class", "prim_lat_dec", "prim_long_dec"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
    return df


def gnis_points(df: DataFrame) -> DataFrame:
    """Gazetteer rows as points of the kept classes, inside the envelope, not historical."""
    c, kind = F.col, classify.lookup(F.col("feature_class"), classify.GNIS_KIND)
    lon, lat = c("prim_long_dec").try_cast("double"), c("prim_lat_dec").try_cast("double")
    ok = kind.isNotNull() & (c("feature_name") != "") & ~F.lower("feature_name").contains("(historical)") & classify.in_envelope(lon, lat)
    zoom = classify.lookup(c("feature_class"), classify.GNIS_ZOOM)
    return df.filter(ok).select(F.concat(F.lit("gnis:"), "feature_id").alias("id"), c("feature_id").alias("gnis_id"), c("feature_name").alias("name"), kind.alias("kind"), zoom.alias("min_zoom"), lon.alias("lon"), lat.alias("lat"))


def read_geonames(spark: SparkSession, path: str) -> DataFrame:
    """A tab-delimited gazetteer of exactly 19 unquoted fields; a row with another number fails the read."""
    # Without pruning every field of a row is looked at, so a short row cannot slip through.
    return spark.read.option("columnPruning", "false").csv(path, schema=GEONAMES, sep="\t", quote="", escape="", mode="FAILFAST")


def geonames_points(df: DataFrame) -> DataFrame:
    """Gazetteer rows of the country as points of the kept codes; height only where it was reported."""
    code = F.concat_ws(".", "class", "code")
    cls = classify.lookup(code, GEONAMES_CLASS)
    spring = F.when(code == "H.SPNT", "hot").when(code == "H.SPNS", "sulphur")
    ok = (F.col("country") == "US") & cls.isNotNull() & (F.col("name") != "") & ~F.lower("name").contains("(historical)") & classify.in_envelope(F.col("lon"), F.col("lat"))
    return df.filter(ok).select(
        F.concat(F.lit("geonames:"), "geonameid").alias("id"), "name", classify.lookup(cls, classify.GNIS_KIND).alias("kind"),
        classify.lookup(cls, classify.GNIS_ZOOM).alias("min_zoom"), "lon", "lat", F.col("elevation").alias("elevation_m"), spring.alias("spring_type"),
    )


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    """Enabled facilities of a recreation CSV with usable positions."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST")
    lon, lat = F.col("FacilityLongitude").try_cast("double"), F.col("FacilityLatitude").try_cast("double")
    ok = F.lower("Enabled").isin("true", "1") & classify.in_envelope(lon, lat)
    return df.filter(ok).select(F.concat(F.lit("ridb:"), "FacilityID").alias("id"), F.col("FacilityName").alias("name"), F.col("FacilityTypeDescription").alias("kind"), lon.alias("lon"), lat.alias("lat"))


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """(file, ring, hole, points) of region files: a name, then rings of lon lat lines each closed by END; ! marks holes."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line <> ''")
    w = Window.partitionBy("file").orderBy("at")
    ring = F.sum((F.col("line") == "END").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    xy = F.split("line", r"\s+")
    point = F.when(F.col("line").rlike(r"^[-+0-9.eE]+\s+[-+0-9.eE]+$") & (F.size(xy) == 2), F.struct(F.col("at"), xy[0].try_cast("double").alias("x"), xy[1].try_cast("double").alias("y")))
    lines = lines.withColumn("ring", F.coalesce(ring, F.lit(0))).withColumn("point", point).withColumn("hole", F.col("line").startswith("!"))
    rings = lines.groupBy("file", "ring").agg(F.max("hole").alias("hole"), F.array_sort(F.collect_list("point")).alias("points"))
    return rings.filter(F.size("points") > 2).select("file", "ring", "hole", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(id, type, coordinates, properties) of a feature collection; gz is read as it is. Coordinates stay JSON."""
    schema = f"features array<struct<id string, geometry struct<type string, coordinates string>, properties struct<{properties}>>>"
    df = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select(F.explode("features").alias("f"))
    return df.select("f.id", "f.geometry.type", "f.geometry.coordinates", "f.properties")


FIX_JSON = "x double, y double, z double, time bigint, accuracy double, altitudeAccuracy double, speed double, heading double, segment bigint, _bad string"


def read_fixes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fixes, unreadable lines) of a GPS log with one JSON object in a line; a torn line spoils no other."""
    df = spark.read.schema(FIX_JSON).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").select("*", F.input_file_name().alias("file"))
    ok = F.col("_bad").isNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("time").isNotNull() & F.col("segment").isNotNull()
    return df.filter(ok).drop("_bad"), df.filter(~ok).select("_bad", "file")
