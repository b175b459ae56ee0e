"""Registered queries against their SQL in DuckDB."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from graftwork.llm.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, SF_DIR).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(mine.column_names)
    assert columns == sorted(theirs.column_names)
    rows = [Counter(zip(*[t.column(c).to_pylist() for c in columns], strict=True)) for t in (mine, theirs)]
    assert rows[0] == rows[1]
    for c in columns:
        assert str(mine.schema.field(c).type) == str(theirs.schema.field(c).type), c
