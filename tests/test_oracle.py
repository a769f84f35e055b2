"""Every registered query against its SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

from shipledger.plans import load_all
from shipledger.plans.registry import ORACLE, QUERIES
from tools.check_oracle import bag

load_all()

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in pathlib.Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    result = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(result.fetchall(), result.columns)
