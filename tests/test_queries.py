"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(set(entry.catalogue.QUERIES) & set(entry.catalogue.ORACLE_SQL))


def rows(frame):
    key = lambda v: (v is None or v != v, str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(key, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF_DIR):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    got, want = entry.catalogue.QUERIES[name](spark, SF_DIR).toPandas(), duck.sql(entry.catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
