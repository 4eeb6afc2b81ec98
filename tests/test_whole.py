"""Queries over whole tables whose case on the smallest tables shows a part only."""

from scoria import plans
from scoria.operators import ledger


def run(spark, name, sf):
    return plans.QUERIES[name](spark, str(sf))


def test_gazetteer_quoted_lines(spark, tmp_path):
    line = '7|{}|Summit|California|Placer|Map|||39.1|-120.2'
    rows = [(1, line.format("Plain Peak")), (2, line.format('"Peak ""A"" | B"')), (3, line.format('Peak "A"')), (4, line.format('"Old (Historical)"'))]
    spark.createDataFrame(rows, "line_id bigint, raw_line string").write.parquet(f"{tmp_path}/gnis_lines.parquet")
    got = {r.line_id: r.name for r in run(spark, "p19_gazetteer_points", tmp_path).collect()}
    assert got == {1: "Plain Peak", 2: 'Peak "A" | B'}


def test_chunks_of_a_wide_grid(spark, tmp_path):
    spark.createDataFrame([(0,), (2499,), (2500,), (3000,)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, run(spark, "r02_chunks", tmp_path).collect()))
    assert got == [(0, 0, 1024), (2499, 2, 953), (2500, 2, 953), (3000, 2, 953)]


def test_audits_reach_every_block(spark, tmp_path):
    blocks = [(i, [i / 1000.0 if i != 7 else -1.0] * 64) for i in range(130) if i != 5]
    spark.createDataFrame(blocks, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, i % 50) for i in range(260)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    value = {5: None, 7: -1000}
    got = dict(map(tuple, run(spark, "j31_cell_audit", tmp_path).collect()))
    assert got == {i: value.get(i % 130, i % 130) for i in range(260)}
    got = {r.cell: (r.covered, r.labels) for r in run(spark, "q09_dem_audit", tmp_path).collect()}
    assert got == {i: (i not in (0, 5, 7), 2) for i in range(130)}


def test_equivalence_both_ways(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id int, k string")
    more = spark.createDataFrame([(1, "x"), (2, None), (2, None), (3, "y")], "id int, k string")
    assert [ledger.differing(*x).first()[0] for x in ((a, a), (a, more), (more, a), (a, a.distinct()))] == [0, 1, 1, 1]


def test_canonical_places_of_any_number(spark, tmp_path):
    """Places are on the map whatever their keys, those past the 360,000th too."""
    keys = [0, 1, 2, 900_000, 900_001, 1_199_998, 1_199_999, 5_000_000_001, 5_000_000_002]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    for name, order in (("j07_dedupe", lambda k: (k * 7 % 5, str(k))), ("j21_client_order", lambda k: (k % 2, k * 7 % 5, str(k)))):
        want = {str(k): str(min((x for x in keys if x // 3 == k // 3), key=order)) for k in keys}
        assert {r.id: r.canonical for r in run(spark, name, tmp_path).collect()} == want
