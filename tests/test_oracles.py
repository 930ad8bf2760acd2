"""Every registered query against its SQL in DuckDB, on the test tables."""

import glob
import os

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as driver
from sessionlake.plans import table_queries

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = table_queries.queries(), table_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(found: pa.Table) -> list[tuple]:
    names = sorted(found.column_names)
    return sorted((tuple(row[n] for n in names) for row in found.to_pylist()), key=repr)


def types(found: pa.Table) -> dict[str, str]:
    return {field.name: str(field.type) for field in found.schema}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, DATA).toArrow()
    assert ours.num_rows > 0
    theirs = duck.execute(ORACLES[name]).to_arrow_table()
    assert types(ours) == types(theirs)
    assert rows(ours) == rows(theirs)


def test_all_are_registered():
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())


def test_entry(spark):
    row = driver.entry(spark).collect()[0].asDict()
    assert (row["users_with_long_session_count"], row["total_users"]) == (14, 15)
    assert row["long_session_threshold"] == 20796
