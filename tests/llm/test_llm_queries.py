"""Each registered query runs; those with SQL give what DuckDB gives."""

import duckdb
import pytest

from tablewright.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n, q in LLM_QUERIES.items() if q.sql])
def test_matches_sql(name, spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = LLM_QUERIES[name].run(spark, SF)
    cursor = con.execute(LLM_QUERIES[name].sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(*names).collect())) == sorted(f"Row({', '.join(f'{n}={v!r}' for n, v in zip(names, r, strict=True))})" for r in cursor.fetchall())


@pytest.mark.parametrize("name", [n for n, q in LLM_QUERIES.items() if not q.sql])
def test_runs(name, spark):
    df = LLM_QUERIES[name].run(spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
