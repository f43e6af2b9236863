import pytest

SF = "/root/testdata/sf0.001"


def test_every_query_is_callable_and_matched(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80
    assert entry.entry(spark).columns == ["kind", "mmsi", "start_time", "end_time"]


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found", "p6_found", "deltas", "split_tracks", "transit_edges", "interp_time", "static_mode_aggregate"])
def test_query_against_sql(spark, name):
    import os

    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple("" if v is None else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r)
    assert sorted(map(key, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(key, want))
