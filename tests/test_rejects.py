"""Rejects: a plain character-by-character reader as the second opinion."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scoria.operators.rejects import parse_lines, split_rejects, typed_gnis


def by_hand(line):
    """(fields, reason) by reading one character at a time."""
    if line is None:
        return None, "column_count"
    fields, i, n = [], 0, len(line)
    while True:
        cur = ""
        if i < n and line[i] == '"':
            i += 1
            while True:
                if i >= n:
                    return None, "quoting"
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        cur, i = cur + '"', i + 2
                        continue
                    i += 1
                    break
                cur, i = cur + line[i], i + 1
            if i < n and line[i] != "|":
                return None, "quoting"
        else:
            while i < n and line[i] != "|":
                if line[i] == '"':
                    return None, "quoting"
                cur, i = cur + line[i], i + 1
        fields.append(cur)
        if i >= n:
            break
        i += 1
    if len(fields) != 10:
        return None, "column_count"
    if not re.fullmatch("[0-9]+", fields[0]) or not 1 <= int(fields[0]) < 2**63:
        return fields, "feature_id"
    for at, limit, name in ((8, 90, "prim_lat_dec"), (9, 180, "prim_long_dec")):
        if not re.fullmatch(r"[+-]?[0-9]+([.][0-9]+)?", fields[at]) or abs(float(fields[at])) > limit:
            return fields, name
    return fields, None


def check(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, raw_line string")
    got = {r["line_id"]: (r["fields"] and list(r["fields"]), r["reason"]) for r in parse_lines(df).collect()}
    assert len(got) == len(lines)
    for i, line in enumerate(lines):
        fields, reason = by_hand(line)
        assert got[i][1] == reason, (line, got[i], reason)
        if fields:
            assert got[i][0] == fields, line


GOOD = "12|A|B|C|D|E|F|G|45.5|-120.25"


def test_cases(spark):
    check(spark, [
        GOOD, None, "", "|", '"12"|A|B|C|D|E|F|G|"45.5"|-120.25', '12|"A|B"|B|C|D|E|F|G|45.5|-120.25', '12|"A ""x"" B"|B|C|D|E|F|G|1|2',
        '12|"A|B|C|D|E|F|G|45.5|-120.25', '12|A"|B|C|D|E|F|G|1|2', '12|"A" b|B|C|D|E|F|G|1|2', '12|""|B|C|D|E|F|G|1|2', '12|"|B|C|D|E|F|G|1|2',
        "0|A|B|C|D|E|F|G|1|2", "9223372036854775807|A|B|C|D|E|F|G|1|2", "9223372036854775808|A|B|C|D|E|F|G|1|2", "0009|A|B|C|D|E|F|G|1|2",
        "٣|A|B|C|D|E|F|G|1|2", "1|A|B|C|D|E|F|G|1|2\n", "1|A|B|C|D|E|F|G|90.0001|2", "1|A|B|C|D|E|F|G|-90|180", "1|A|B|C|D|E|F|G|1.|2", "1|A|B|C|D|E|F|G|.5|2",
        "1|A|B|C|D|E|F|G|+1|1e1", '1|"a\nb"|B|C|D|E|F|G|1|2', GOOD, GOOD + "|", "1|" + "x" * 200_000 + "|B|C|D|E|F|G|1|2", '1|"' + '""' * 20_000 + '"|B|C|D|E|F|G|1|2',
    ])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(lines=st.lists(st.one_of(st.text('"|a1.\n', max_size=14), st.lists(st.sampled_from(["1", '"', '""', '"a|b"', "-5.5", "x", "", "91"]), min_size=9, max_size=11).map("|".join)), min_size=40, max_size=60))
def test_like_by_hand(spark, lines):
    check(spark, lines)


def test_clashing_columns_and_types(spark):
    df = spark.createDataFrame([(1, GOOD, "x", "y", "z", "w")], "line_id int, raw_line string, reason string, fields string, parsed_line string, v0 string")
    row = parse_lines(df).first().asDict()
    assert row["reason"] == "x" and row["fields"] == "y" and row["_reason"] is None and row["_fields"]["feature_name"] == "A" and row["v0"] == "w"
    good, bad = split_rejects(df.select("line_id", "raw_line"))
    assert bad.count() == 0
    r = typed_gnis(good).first()
    assert (r["feature_id"], r["lat"], r["lon"]) == (12, 45.5, -120.25)


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id int, raw_line string")
    good, bad = split_rejects(df)
    assert good.count() == 0 and bad.count() == 0


def test_large_dictionary_is_joined_in_salts(spark, monkeypatch):
    """Where the bad values do not fit a broadcast, lines with one bad value are spread, and the verdicts are the same."""
    from scoria import session
    from scoria.operators.rejects import parse_lines

    line = "{}|N|C|S|K|M|||{}|1.5"
    rows = [(i, line.format("x" if i % 3 == 0 else i + 1, "95" if i % 7 == 0 else "1.0")) for i in range(600)]
    df = spark.createDataFrame(rows, "line_id long, raw_line string").selectExpr("*", "1 as salt", "2 as salt_of")
    want = {r["line_id"]: r["reason"] for r in parse_lines(df).collect()}
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    out = parse_lines(df)
    assert {r["line_id"]: r["reason"] for r in out.collect()} == want and out.columns[:4] == df.columns and len(out.columns) == 6
    assert want[0] == "feature_id" and want[7] == "prim_lat_dec" and want[1] is None
