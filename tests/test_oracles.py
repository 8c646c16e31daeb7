"""Every registered query with SQL equals that SQL; the others run and keep their schema."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import canonical
from registry.base import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, FOLDER)
    columns, rows = canonical(df.columns, df.collect())
    assert rows
    if name in oracle_sql():
        got = db.execute(oracle_sql()[name])
        assert (columns, rows) == canonical([d[0] for d in got.description], got.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 101


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
