"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from tablewright.plans.registry import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


def table(names, found):
    order = sorted(names)
    at = [names.index(c) for c in order]
    lines = [tuple(plain(r[i]) for i in at) for r in found]
    return order, sorted(lines, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(name, spark, duck):
    query = QUERIES[name]
    df = query.run(spark, SF_DIR)
    mine = table(df.columns, df.collect())
    cursor = duck.execute(query.sql)
    assert mine == table([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(name, spark):
    df = QUERIES[name].run(spark, SF_DIR)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    found = contract.entry(spark)
    assert {"split", "accuracy", "auc"} <= set(found.columns)
    assert found.count() == 3
