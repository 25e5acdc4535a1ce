"""Catalogue queries against their SQL on the small tables."""

import duckdb
import pytest

from loomfold.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(str, frame[cols].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL) - {"h10_hybrid_parents", "a13_context"}))
def test_runs_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(catalogue.queries())
