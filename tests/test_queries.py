"""Every registered query of the reference's own operators against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from haulspark.plans import basic, domain, operations, roads, shapes
from haulspark.plans.carriers import TABLES

SF = "/root/testdata/sf0.001"
PLANS = (basic, domain, operations, roads, shapes)
QUERIES, SQL = ({k: v for p in PLANS for k, v in getattr(p, name).items()} for name in ("QUERIES", "SQL"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return "null"
        return repr(round(float(x), 7)) if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x).removesuffix(" 00:00:00")

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = plain(got), plain(want)
        norm = lambda rows: sorted(tuple(c.removesuffix(".0") for c in r) for r in rows)
        assert norm(a) == norm(b)
