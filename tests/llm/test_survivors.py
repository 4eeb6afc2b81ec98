"""Best records: dates, agencies, values that say nothing, ties and odd rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from scoria.llm.survivors import best_records, canonical_agency, field_winners, telling, written_day

SCHEMA = "id string, match_group string, name string, agency string, elevation_m double, source_records string"
RANKS = [("NPS", "National Park Service", 0), ("USFS", "United States Forest Service", 1), ("Recreation.gov", "Recreation Information Database", 2),
         ("USGS GNIS", "Geographic Names Information System", 3), ("GeoNames", "GeoNames Gazetteer", 4)]


def rec(id_, updated=None, phone=None, water=None, others=()):
    return json.dumps([*others, {"id": id_, "agency": "", "details": {"updated": updated, "phone": phone, "water": water}}])


def run(spark, rows):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(RANKS, "agency string, full_name string, trust_rank int")


def test_dates(spark):
    said = {"2020-02-22": (2020, 2, 22), "2014-03-01T00:00:00Z": (2014, 3, 1), "04/30/2020": (2020, 4, 30), "30/04/2020": (2020, 4, 30), "2 Jun 2012": (2012, 6, 2),
            "12 October 2024": (2024, 10, 12), "1638403200000": (2021, 12, 2), "1638403200": (2021, 12, 2), "2020-02-31": None, "soon": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert [r[0] for r in df.select(written_day(F.col("t"))).collect()] == [v and dt.date(*v) for v in said.values()]


def test_agencies_and_nothing(spark):
    said = {"Nat'l Park Svc": "NPS", "N.P.S.": "NPS", " usfs ": "USFS", "Forest Service (USFS)": "USFS", "RIDB": "Recreation.gov", "Recreation gov": "Recreation.gov", "U.S.G.S. GNIS": "USGS GNIS", "Geo Names": "GeoNames", "": None, None: None, "Unknown": None, "County": "County",
            "USDA Forest Service": "USFS", "US Forest Svc": "USFS", "U.S. Forest Service": "USFS", "GNIS": "USGS GNIS", "Rec.gov": "Recreation.gov", "Nat. Park Service": "NPS", "California State Parks": "California State Parks",
            "Texas Parks and Wildlife": "Texas Parks and Wildlife", "Georgia Department of Forestry": "Georgia Department of Forestry", "Alaska Geological Survey": "Alaska Geological Survey", "National": "National"}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert [r[0] for r in df.select(canonical_agency(F.col("t"), [r[:2] for r in RANKS])).collect()] == list(said.values())
    df = spark.createDataFrame([("No",), ("none",), ("N/A",), ("?",), (" ",), ("Not available",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(telling(F.col("t"))).collect()] == ["No", None, None, None, None, None, "x", None]


def test_winners(spark):
    rows = [
        ("a", "g", "Foo", "usfs", -9999.0, rec("a", "2020-01-01", "555-1", "Yes")),
        ("b", "g", "Bar", "NPS", 100.0, rec("b", "2019-01-01", "n/a", "No", [{"id": "z", "details": {"phone": "9"}}])),
        ("c", "g", "unnamed", "NPS", 200.0, rec("c", "06/01/2019", None, "Unknown")),
        ("c", "g", "unnamed", "NPS", 200.0, rec("c", "06/01/2019", None, "Unknown")),
        ("d", "g", None, None, None, None), ("e", "g", "Baz", "", 5.0, "[{broken"), (None, "g", "x", "NPS", 1.0, None),
        ("f", None, "x", "NPS", 1.0, rec("f")), ("h", "only", "TBD", "NPS", -9999.0, rec("h", None, "-", "?")),
        ("t2", "tie", "T2", "NPS", None, rec("t2", "2020-01-01")), ("t1", "tie", "T1", "NPS", None, rec("t1", 1577836800000)),
    ]
    f, a = run(spark, rows)
    f = f.selectExpr("*", "1 as said", "2 as trust_rank", "3 as day", "4 as value", "5 as own")
    got = {(r["match_group"], r["field_name"]): r["id"] for r in field_winners(f, a).collect()}
    assert got == {("g", "name"): "b", ("g", "elevation_m"): "c", ("g", "phone"): "a", ("g", "water"): "b", ("tie", "name"): "t1"}
    best = {r["match_group"]: r for r in best_records(f, a).collect()}
    assert best["g"]["name"] == "Bar" and best["g"]["elevation_m"] == 200.0 and best["g"]["phone"] == "555-1" and set(best) == {"g", "only", "tie"} and best["only"]["name"] is None


def test_large_group_and_empty(spark):
    rows = [(f"i{k}", "g", "N" * 50, "NPS", float(k % 50), rec(f"i{k}", "2020-01-01")) for k in range(3000)]
    f, a = run(spark, rows)
    assert {(r["field_name"], r["id"]) for r in field_winners(f, a).collect()} == {("name", "i0"), ("elevation_m", "i0")}
    assert field_winners(f.limit(0), a).count() == 0 and best_records(f.limit(0), a).count() == 0
    assert field_winners(f, a.limit(0)).count() == 2
    plan = field_winners(f, a)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
