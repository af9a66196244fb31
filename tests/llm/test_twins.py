"""Queries of the corpus operators against their DuckDB twins (sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from alertsieve.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})")
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_all_numbered_queries_are_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()
