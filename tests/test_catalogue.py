"""The catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from wordloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("part", "events", "documents", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(["null" if v is None or isinstance(v, float) and math.isnan(v) else str(v) for v in row]) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, FOLDER).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_plans(spark):
    explain = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in explain(catalogue.queries()["page_first"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,SMALL)]" in explain(catalogue.queries()["filter_eq"](spark, FOLDER))
