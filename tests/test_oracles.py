"""Every registered query against its SQL text in DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from graftwork.plans.bindings import TABLES
from graftwork.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _rows(table, columns):
    return Counter(zip(*[[_value(v) for v in table.column(c).to_pylist()] for c in columns], strict=True))


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    mine = QUERIES[name](spark, SF_DIR).toArrow()
    theirs = duck.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(mine.column_names)
    assert columns == sorted(theirs.column_names)
    for c in columns:
        assert str(mine.schema.field(c).type) == str(theirs.schema.field(c).type), c
    assert _rows(mine, columns) == _rows(theirs, columns)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
