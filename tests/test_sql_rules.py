"""SQL of queries states the query's rule where small tables can't tell."""

import duckdb

from haulspark.plans import basic, operations

SF = "/root/testdata/sf0.1"


def agree(spark, plan, name, folder, **tables):
    con = duckdb.connect()
    for t, text in tables.items():
        con.execute(f"COPY ({text}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(plan.SQL[name])
    columns = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    assert sorted(tuple(r) for r in plan.QUERIES[name](spark, str(folder)).select(*columns).collect()) == want
    return want


def test_the_first_line_goes_before_any_part_number(spark, tmp_path):
    rows = "SELECT * FROM (VALUES (1::BIGINT, 2, 1500000::BIGINT, 3.0::DOUBLE, 'A'), (1, 1, 5, 2.0, 'N'), (2, 3, 7, 1.0, 'R'), (2, 1, 2000007, 4.0, 'R')) t(l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag)"
    assert [r[:2] for r in agree(spark, basic, "record_merge", tmp_path, lineitem=rows)] == [(1, 1500000), (2, 2000007)]


def test_shops_beyond_the_ends_of_a_road_are_near_it(spark, tmp_path):
    got = agree(spark, operations, "mechanics_fallback", tmp_path, part=f"SELECT * FROM '{SF}/part.parquet' WHERE p_partkey IN (3388, 9354, 16747) OR p_partkey < 2000")
    assert {3388, 9354, 16747} < {r[0] for r in got}
