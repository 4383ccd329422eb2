"""Every query with a DuckDB statement gives the same rows, on the smallest tables."""

import math
import os

import duckdb
import pytest

from trackfit import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def canonical(rows):
    plain = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    return sorted(tuple(map(repr, map(plain, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_statement(spark, duck, name):
    want = duck.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canonical(tuple(r) for r in got.select(columns).collect()) == canonical(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
