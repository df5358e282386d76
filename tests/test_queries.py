"""Every registered query against its SQL, value by value."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("LAMELLA_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    return str(value)


def as_rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    assert as_rows(got.columns, got.collect()) == as_rows(want.columns, want.fetchall())


def test_every_sql_has_a_query_and_the_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
