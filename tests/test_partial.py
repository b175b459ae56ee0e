"""Merges of models that lack blocks which others have, on rows made here."""

import json

import duckdb
import pytest

from graftwork.operators import merging as M
from graftwork.plans.catalog import ORACLES, QUERIES
from graftwork.sources import safetensors as S

# Queries over all models; 117 vectors leave the last blocks to some of the models only.
RAGGED = (
    "J10_task_vectors",
    "M1_average_params",
    "M1_merge_average",
    "M2_merge_linear",
    "M3_merge_ties",
    "M2_linear_merge",
    "M2_merge_full_models",
    "M3_ties_merge",
    "M3_ties_merge_untrimmed",
    "M4_dare_ties_merge",
    "S13_write_params",
    "S13_write_tensor_files",
    "W9_magnitude_trim",
)
DDL = "model string, tensor string, block_no bigint, values_ array<float>"


@pytest.fixture(scope="module")
def ragged(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ragged")
    vectors = [(i, [((i * 37 + k * k * 11) % 97 - 48) / 32 for k in range(64)]) for i in range(117)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    orders = [(i, i * 7 % 31, "F" if i * 13 % 11 < 5 else "O", float(i)) for i in range(400)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double").write.parquet(f"{root}/orders.parquet")
    return str(root)


@pytest.mark.parametrize("name", RAGGED)
def test_ragged_models(spark, ragged, name):
    con = duckdb.connect()
    for t in ("embeddings", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ragged}/{t}.parquet/*.parquet'")
    mine = QUERIES[name](spark, ragged).toArrow()
    cols = ", ".join(sorted(mine.column_names))
    con.register("mine", mine)
    con.execute(f"CREATE TABLE theirs AS {ORACLES[name]}")
    assert con.sql("SELECT COUNT(*) FROM theirs").fetchall()[0][0] == mine.num_rows > 0
    assert not con.sql(f"SELECT {cols} FROM mine EXCEPT ALL SELECT {cols} FROM theirs").fetchall()
    con.close()


def _merged(df):
    return {(r.tensor, r.block_no): list(r["values_"]) for r in df.collect()}


def test_blocks_of_some_models(spark):
    rows = [("a", "q", 0, [1.0, 3.0]), ("b", "q", 0, [3.0, -1.0]), ("b", "q", 1, [5.0, 7.0]), ("a", "q", 1, None), ("a", "q", 2, [9.0, 9.0])]
    params = spark.createDataFrame(rows, DDL)
    recipe = spark.createDataFrame([("t", "a", 0, 1.0), ("t", "b", 1, 3.0)], "target string, model string, ord bigint, weight double")
    base = spark.createDataFrame([("q", 0, [1.0, 1.0]), ("q", 1, [1.0, 1.0])], "tensor string, block_no bigint, values_ array<float>")
    loose = {("q", 1): [5.0, 7.0], ("q", 2): [9.0, 9.0]}
    assert _merged(M.average_params(params, recipe, partial=True)) == {("q", 0): [2.0, 1.0]} | loose
    assert _merged(M.linear_merge(params, recipe, partial=True)) == {("q", 0): [2.5, 0.0]} | loose
    signed = {("q", 0): [3.0, -1.0], ("q", 1): [5.0, 7.0]}
    assert _merged(M.ties_merge(params, base, recipe, partial=True)) == signed
    assert _merged(M.dare_ties_merge(params, base, recipe, partial=True)) == signed
    vectors = {(r.model, r.block_no): list(r.delta) for r in M.task_vectors(params, base, partial=True).collect()}
    assert vectors == {("a", 0): [0.0, 2.0], ("b", 0): [2.0, -2.0], ("b", 1): [4.0, 6.0]}
    twice = params.unionByName(params.filter("block_no = 0"))
    for merged in (M.average_params(twice, recipe, partial=True), M.linear_merge(twice, recipe, partial=True), M.ties_merge(twice, base, recipe, partial=True)):
        with pytest.raises(Exception, match="repeats block 0"):
            merged.collect()


def test_shapes_of_some_rows(spark, tmp_path):
    rows = [("a", "q", 0, [1.0, 3.0], [1, 2]), ("b", "q", 0, [3.0, 5.0], [2, 2]), ("b", "q", 1, [5.0, 7.0], [2, 2])]
    params = spark.createDataFrame(rows, f"{DDL}, shape array<bigint>")
    recipe = spark.createDataFrame([("t", "a", 0), ("t", "b", 1)], "target string, model string, ord bigint")
    merged = M.merge(M.AVERAGE, params, recipe, partial=True)
    assert {tuple(r["shape"]) for r in merged.collect()} == {(2, 2)}
    S.write_safetensors(merged, str(tmp_path)).collect()
    raw = (tmp_path / "t" / S.FILE).read_bytes()
    assert json.loads(raw[8 : 8 + int.from_bytes(raw[:8], "little")])["q"]["shape"] == [2, 2]
    with pytest.raises(ValueError, match="shape of q for t"):
        M.merge(M.AVERAGE, params.replace({"b": "c"}, subset=["model"]).unionByName(spark.createDataFrame([("b", "q", 0, [1.0], [1, 1])], params.schema)), recipe, partial=True)
