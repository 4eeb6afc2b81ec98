"""Rows that fail to parse: split delimited lines into sound rows and rejects with a reason.

Method: structural checks in one JVM expression per line, then every distinct value of
each checked column is cast once; values that fail make a dictionary (column, value,
reason), which is joined back to the lines. The dictionary holds invalid values only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fits, fresh, store

GNIS_FIELDS = (
    "feature_id", "feature_name", "feature_class", "state_name", "county_name", "map_name",
    "date_created", "date_edited", "prim_lat_dec", "prim_long_dec",
)

_NUMBER = r"^[+-]?[0-9]+([.][0-9]+)?\z"
#: Parts of the lines when the dictionary of bad values is too large to broadcast.
SALTS = 16


def valid_id(value: Column) -> Column:
    """Digits 0-9 only, with a value from 1 to 2^63-1."""
    digits = F.regexp_replace(value, "^0+", "")
    number = F.when(F.length(digits) <= 19, digits).try_cast("bigint")
    return value.rlike(r"^[0-9]+\z") & F.coalesce(number >= 1, F.lit(False))


def valid_degrees(limit: float):
    """An optional sign, digits and optionally a dot with more digits, within the limit."""

    def check(value: Column) -> Column:
        return value.rlike(_NUMBER) & F.coalesce(F.abs(value.try_cast("double")) <= limit, F.lit(False))

    return check


GNIS_CHECKS = {"feature_id": valid_id, "prim_lat_dec": valid_degrees(90.0), "prim_long_dec": valid_degrees(180.0)}


def _fields(line: str, sep: str) -> str:
    """SQL for struct(fields, bad_quote) of a line; a fold over the pieces between quotes."""
    split = f"split({line}, '[{sep}]', -1)"
    pieces = f"split({line}, '\"', -1)"
    last = "(e.i = s.n - 1)"
    part = f"split(e.p, '[{sep}]', -1)"
    n = f"size({part})"
    fold = f"""aggregate(
      transform({pieces}, (p, i) -> named_struct('p', p, 'i', i)),
      named_struct('f', cast(array() as array<string>), 'cur', '', 'mode', 0, 'bad', false, 'n', size({pieces})),
      (s, e) -> CASE
        WHEN s.mode = 1 THEN named_struct('f', s.f, 'cur', concat(s.cur, e.p), 'mode', 2, 'bad', s.bad OR {last}, 'n', s.n)
        WHEN s.mode = 2 AND e.p = '' AND NOT {last}
          THEN named_struct('f', s.f, 'cur', concat(s.cur, '"'), 'mode', 1, 'bad', s.bad, 'n', s.n)
        ELSE named_struct(
          'f', CASE WHEN {n} = 1 THEN s.f
                    ELSE concat(s.f, array(concat(s.cur, element_at({part}, 1))), slice({part}, 2, {n} - 2)) END,
          'cur', CASE WHEN {n} = 1 THEN concat(s.cur, e.p) ELSE element_at({part}, -1) END,
          'mode', 1,
          'bad', s.bad OR (s.mode = 2 AND e.p <> '' AND NOT startswith(e.p, '{sep}'))
                 OR (NOT {last} AND e.p <> '' AND NOT endswith(e.p, '{sep}')),
          'n', s.n) END,
      s -> named_struct('f', concat(s.f, array(s.cur)), 'bad', s.bad))"""
    return f"""CASE WHEN {line} IS NULL THEN named_struct('f', cast(array() as array<string>), 'bad', false)
      WHEN instr({line}, '"') = 0 THEN named_struct('f', {split}, 'bad', false) ELSE {fold} END"""


def parse_lines(df: DataFrame, line: str = "raw_line", fields=GNIS_FIELDS, checks=None, sep: str = "|") -> DataFrame:
    """Every input row with two more columns: `fields` (struct of strings) and `reason`.

    `reason` is null for a sound line, else the first that applies of `quoting`,
    `column_count` and the names of the checked columns in the order of `checks`. A null
    or empty line has no ten fields: `column_count`. `fields` is null where the structure is
    unsound. Existing columns keep their names; new ones get underscores in front where
    they would clash. Repeated rows stay repeated; an empty table gives an empty table.
    """
    checks = GNIS_CHECKS if checks is None else checks
    raw, parsed, why = fresh(df, "parsed_line", "fields", "reason")
    dup = fresh(df, *(f"v{i}" for i in range(len(checks))))
    out = df.withColumn(raw, F.expr(_fields(f"`{line}`", sep)))
    array = F.col(raw)["f"]
    sound = ~F.col(raw)["bad"] & (F.size(array) == len(fields))
    struct = F.struct(*(array[i].alias(f) for i, f in enumerate(fields)))
    why_structure = F.when(F.col(raw)["bad"], "quoting").when(F.size(array) != len(fields), "column_count")
    out = out.withColumn(parsed, F.when(sound, struct)).withColumn(why, why_structure).drop(raw)

    each = F.array(*(F.struct(F.lit(c).alias("c"), F.col(parsed)[c].alias("v")) for c in checks))
    values = (
        out.filter(F.col(parsed).isNotNull())
        .select(F.explode(each).alias("x"))
        .groupBy("x.c", "x.v")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    ok = F.lit(False)
    for c, check in checks.items():
        ok = ok | ((F.col("c") == c) & check(F.col("v")))
    # The verdict hangs on `rows`, an aggregate: else it would be pushed below it, to every row.
    failed = F.when(F.col("rows") > 0, ~F.coalesce(ok, F.lit(False))).otherwise(False)
    bad = store(values.filter(failed).select("c", "v"))
    here = fits(bad)
    # Beyond a broadcast, one bad value may be on a third of all lines: lines are spread over salts, and the dictionary goes to each.
    (salt, salt_of) = fresh(out, "salt", "salt_of")
    if not here:
        out = out.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    reason = F.col(why)
    for name, c in zip(dup, checks):
        side, on = bad.filter(F.col("c") == c).select(F.col("v").alias(name)), F.col(parsed)[c] == F.col(name)
        if here:
            out = out.join(F.broadcast(side), on, "left")
        else:
            side = side.withColumn(salt_of, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            out = out.join(side, on & (F.col(salt) == F.col(salt_of)), "left").drop(salt_of)
        reason = F.coalesce(reason, F.when(F.col(name).isNotNull(), F.lit(c)))
    return out.withColumn(why, reason).drop(*dup, salt)


def split_rejects(df: DataFrame, line: str = "raw_line", **how) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejects with `reason`); see parse_lines for the rules."""
    kept = df.columns
    out = parse_lines(df, line, **how)
    parsed, why = out.columns[len(kept)], out.columns[len(kept) + 1]
    good = out.filter(F.col(why).isNull()).select(*(F.col(f"`{c}`") for c in kept), F.col(parsed))
    return good, out.filter(F.col(why).isNotNull()).drop(parsed)


def typed_gnis(good: DataFrame, parsed: str = "fields") -> DataFrame:
    """Sound lines with their three checked fields as numbers."""
    f = F.col(parsed)
    return good.select(
        "*",
        F.regexp_replace(f["feature_id"], "^0+", "").try_cast("bigint").alias("feature_id"),
        f["prim_lat_dec"].try_cast("double").alias("lat"),
        f["prim_long_dec"].try_cast("double").alias("lon"),
    )
