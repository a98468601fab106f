"""Every catalogue query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import pytest

from netquill.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        table = name.removesuffix(".parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def canonical(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.5g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert canonical(map(tuple, got.select(*names).collect())) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_random_queries_repeat(spark, name):
    """What SQL can't express is seeded: a second run gives the same rows."""
    a, b = (sorted(map(str, catalogue.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b and a
