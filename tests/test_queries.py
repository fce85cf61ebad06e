"""Every registered query with SQL against DuckDB, on tables with enough rows for ties and borders."""

import math
import os

import pytest

from hazgrid.plans import registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _rows(columns, rows):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, (int, bool)) or hasattr(x, "is_integer") and float(x).is_integer():
            return f"{float(x):.6f}"
        return f"{float(x):.6f}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([plain(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF)
    theirs = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert _rows(ours.columns, ours.collect()) == _rows(columns, theirs.fetchall())


def test_each_sql_has_a_query():
    assert registry.oracle_sql().keys() <= registry.queries().keys()


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
