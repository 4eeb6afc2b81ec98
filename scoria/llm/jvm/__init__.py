"""Functions in Java for the operators of this subpackage: words, seeds and names."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JAR = os.path.join(os.path.dirname(os.path.abspath(__file__)), "texts.jar")
#: Functions by name, with their class and the type that each gives.
FUNCTIONS = {
    "WordIds": ("Leaks", "array<bigint>"), "Choose": ("Leaks", "array<bigint>"), "Hits": ("Leaks", "array<struct<h:bigint,at:int>>"), "Probes": ("Leaks", "array<bigint>"),
    "Stretch": ("Leaks", "struct<share:double,weight:double>"),
    "NameFamily": ("NameUdfs", "int"), "NameWords": ("NameUdfs", "array<string>"), "NameGrams": ("NameUdfs", "array<int>"), "NamePrefix": ("NameUdfs", "array<int>"),
    "NameAlike": ("NameUdfs", "double"), "WordHash": ("NameUdfs", "bigint"),
    "NameText": ("NameUdfs", "string"), "KeyBits": ("NameUdfs", "bigint"), "KindBits": ("NameUdfs", "bigint"), "MarkBits": ("NameUdfs", "bigint"), "PlaceBits": ("NameUdfs", "bigint"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; done once for each."""
    if spark.catalog.functionExists("t_wordids"):
        return
    from pyspark.sql.types import _parse_datatype_string

    spark.sql(f"ADD JAR '{JAR}'")
    for name, (home, kind) in FUNCTIONS.items():
        spark.udf.registerJavaFunction(f"t_{name.lower()}", f"scoria.llm.{home}${name}", _parse_datatype_string(kind))


def t(name: str, *args) -> Column:
    """A function of columns and plain values."""
    return F.call_function(f"t_{name.lower()}", *(a if isinstance(a, Column) else F.lit(a) for a in args))


def bit_set(df: DataFrame, column: str, size: int, most: int) -> bytes:
    """Bits 0 to 2^k - 1 as bytes, three set for each of a column's values; k as `size` values need, at most `most`.

    2^k bytes / 8 reach the driver, whatever the number of rows.
    """
    k = max(10, min(most, (64 * max(1, size) - 1).bit_length()))
    at = df.select(F.explode(t("Probes", F.col(column), k)).alias("b"))
    words = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("v"))
    out = bytearray((1 << k) // 8)
    for row in words.toLocalIterator():
        out[8 * row["w"] : 8 * row["w"] + 8] = (row["v"] & ((1 << 64) - 1)).to_bytes(8, "little")
    return bytes(out)
