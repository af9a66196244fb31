"""Every catalogue query against its DuckDB twin (sf0.001), and the
row-checked ones for shape."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from alertsieve.plans import catalog
from conftest import SF_SMALL

TABLES = ["events"]
SLOW = {"model_suite", "temporal_cv", "attribution_ranking", "linear_attribution", "model_roundtrip"}


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, float):
        return (1, f"{v:.9f}")
    return (1, str(v))


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(None if x is not None and not isinstance(x, str) and x != x else x)
                              for x in rec) for rec in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_twin(spark, con, name):
    sp = catalog.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.sql(catalog.oracle_sql()[name]).df()
    sc, sr = _rows(sp)
    dc, dr = _rows(dk)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_every_query_has_a_builder():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.queries()) <= set(E.queries())
    without = set(catalog.queries()) - set(catalog.oracle_sql())
    assert without == {"score_anomaly", "score_alerts", "model_suite", "temporal_cv", "attribution_ranking",
                       "linear_attribution"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "alert_title" in df.columns
