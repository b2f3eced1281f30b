"""Every panel query against its oracle, on the driver's smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from hourloom.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(frame, columns):
    return sorted(map(str, frame[columns].astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert rows(mine, columns) == rows(theirs, columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 912


def test_all_queries_are_registered():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
