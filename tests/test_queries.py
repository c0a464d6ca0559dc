"""Every registered query against its SQL, on the smallest supplied data."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from oracle import connect, spark_rows, sql_rows
from rowtide.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="supplied data not present")


@pytest.fixture(scope="module")
def sql():
    return connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def generated_code(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", True)
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", False)


def test_entry(spark):
    assert contract.entry(spark).columns == ["id", "status", "amount"]


def test_every_query_has_sql():
    assert all(q.sql for q in QUERIES.values())
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    assert spark_rows(contract.queries()[name](spark, SF_DIR)) == sql_rows(sql, contract.oracle_sql()[name])
