"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest
from compare import assert_same

import __spark_entry__ as entry
from workload.oracles import ORACLES
from workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(name, spark, sf_dir, duck):
    result = entry.queries()[name](spark, sf_dir)
    assert_same(result, duck.execute(entry.oracle_sql()[name]))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
