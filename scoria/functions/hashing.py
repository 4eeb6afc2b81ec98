"""Stable ids from texts and packed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_id48(text: Column) -> Column:
    """The first six bytes of the text's SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def hashed_id53(text: Column) -> Column:
    """The first seven bytes of the text's SHA-256, cut to 53 bits."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("bigint").bitwiseAND(F.lit((1 << 53) - 1))


def packed_way_id(packed: Column) -> Column:
    """The way's number of a packed 64-bit id, null for another type of element."""
    return F.when(F.shiftright(packed, 44) == 2, packed.bitwiseAND(F.lit((1 << 44) - 1)))
