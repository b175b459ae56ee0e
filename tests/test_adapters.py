"""Low-rank products on block tables against numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graftwork.operators import adapters as A
from graftwork.operators import merging as M

PARAMS = "model string, tensor string, block_no bigint, values_ array<float>, shape array<bigint>"


def _blocks(model, tensor, matrix, length):
    flat = matrix.astype("f4").ravel()
    return [(model, tensor, k, flat[at : at + length].tolist(), list(matrix.shape)) for k, at in enumerate(range(0, len(flat), length))]


def _case(spark, rows, columns, ranks, lengths, seed=0):
    rng = np.random.default_rng(seed)
    base = {"x.weight": rng.normal(size=(rows, columns)), "norm.weight": rng.normal(size=(7,))}
    table, factors = [], {}
    for k, rank in enumerate(ranks):
        a, b = rng.normal(size=(rank, columns)).astype("f4"), rng.normal(size=(rows, rank)).astype("f4")
        factors[f"m{k}"] = (a, b)
        table += _blocks(f"m{k}", "base_model.model.x.lora_A.weight", a, lengths[0]) + _blocks(f"m{k}", "base_model.model.x.lora_B.default.weight", b, lengths[1])
    own = [r[1:] for t, m in base.items() for r in _blocks("", t, m, lengths[2])]
    return spark.createDataFrame(table, PARAMS), spark.createDataFrame(own, PARAMS.replace("model string, ", "")), base, factors


def _whole(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["model"], r["tensor"]), {})[r["block_no"]] = r["values_"]
    return {k: np.concatenate([v[i] for i in sorted(v)]) for k, v in out.items()}


@pytest.mark.parametrize(
    ("rows", "columns", "ranks", "lengths", "tile"),
    [(16, 16, (4,), (64, 64, 64), 1024), (13, 7, (2, 5), (3, 4, 10), 3), (5, 40, (3,), (17, 2, 11), 8), (40, 5, (1,), (5, 9, 200), 8), (1, 1, (1,), (1, 1, 1), 1)],
)
def test_products_against_numpy(spark, rows, columns, ranks, lengths, tile):
    params, base, matrices, factors = _case(spark, rows, columns, ranks, lengths)
    scales = spark.createDataFrame([(m, 0.5 + k) for k, m in enumerate(factors)], "model string, scale double")
    got = _whole(A.onto_base(params.repartition(5), base, scales, tile))
    assert set(got) == {(m, t) for m in factors for t in matrices}
    for k, (m, (a, b)) in enumerate(factors.items()):
        want = matrices["x.weight"].astype("f4") + (0.5 + k) * (b.astype("f8") @ a)
        assert np.allclose(got[m, "x.weight"], want.ravel(), atol=1e-5)
        assert np.array_equal(got[m, "norm.weight"], matrices["norm.weight"].astype("f4"))


def test_what_does_not_fit_fails(spark):
    params, base, _, _ = _case(spark, 6, 4, (2, 2), (3, 4, 10))
    scales = spark.createDataFrame([("m0", 1.0), ("m1", 1.0)], "model string, scale double")
    with pytest.raises(ValueError, match="do not fit"):
        A.onto_base(params.filter("NOT (model = 'm1' AND tensor LIKE '%lora_B%')"), base, scales)
    with pytest.raises(ValueError, match="the base lacks x.weight"):
        A.onto_base(params, base.filter("tensor <> 'x.weight'"), scales)
    with pytest.raises(ValueError, match="no factors for m1"):
        A.onto_base(params.filter("model = 'm0'"), base, scales)
    with pytest.raises(Exception, match="lacks blocks of the factors"):
        A.onto_base(params.filter("NOT (model = 'm1' AND tensor LIKE '%lora_B%' AND block_no = 1)"), base, scales).collect()
    with pytest.raises(Exception, match="the base lacks block 1"):
        A.onto_base(params, base.filter("NOT (tensor = 'x.weight' AND block_no = 1)"), scales).collect()


def test_merging_adapters_with_a_full_model(spark):
    params, base, matrices, factors = _case(spark, 6, 4, (2,), (3, 4, 10))
    full = {t: np.full(m.shape, 2.0) for t, m in matrices.items()}
    rows = [r for t, m in full.items() for r in _blocks("full", t, m, 10)]
    params = params.unionByName(spark.createDataFrame(rows, PARAMS))
    recipe = spark.createDataFrame([("t", "m0", 0, 1.0), ("t", "full", 1, 3.0)], "target string, model string, ord bigint, weight double")
    scales = spark.createDataFrame([("m0", 2.0)], "model string, scale double")
    merged = M.merge_onto_base(M.LINEAR, params, recipe, base, scales)
    got = _whole(merged.withColumnRenamed("target", "model"))
    a, b = factors["m0"]
    want = (matrices["x.weight"].astype("f4") + 2.0 * (b.astype("f8") @ a) + 3 * 2.0) / 4
    assert np.allclose(got["t", "x.weight"], want.ravel(), atol=1e-5)
    assert np.allclose(got["t", "norm.weight"], (matrices["norm.weight"] + 6) / 4, atol=1e-5)


def test_full_models_keep_embeddings_and_targets_their_shapes(spark):
    one = np.ones((2, 2))
    rows = [r for m in "abcd" for t in ("embed_tokens.weight", "layers.0.weight") for r in _blocks(m, t, one if m in "ab" else np.ones((3, 2)), 4)]
    params = spark.createDataFrame(rows, PARAMS)
    recipe = spark.createDataFrame([("t", "a", 0), ("t", "b", 1), ("u", "c", 0), ("u", "d", 1)], "target string, model string, ord bigint")
    got = {(r.target, r.tensor, r.block_no): r.shape for r in M.merge(M.LINEAR, params, recipe).collect()}
    assert {k[1] for k in got} == {"embed_tokens.weight", "layers.0.weight"}
    assert all(v == ([2, 2] if k[0] == "t" else [3, 2]) for k, v in got.items())
    # Adapters may differ in the embeddings that they lose.
    mixed = spark.createDataFrame([("t", "a", 0), ("t", "c", 1)], "target string, model string, ord bigint").withColumn("is_adapter", F.lit(True))
    same = params.filter("tensor LIKE 'embed%' OR model IN ('a', 'b')").unionByName(
        spark.createDataFrame(_blocks("c", "layers.0.weight", one, 4), PARAMS)
    )
    assert {r.tensor for r in M.merge(M.LINEAR, same, mixed).collect()} == {"layers.0.weight"}
    with pytest.raises(ValueError, match="embed_tokens.weight for t"):
        M.merge(M.LINEAR, same, mixed.withColumn("is_adapter", F.lit(False)))


def test_vectors_need_the_base(spark):
    params = spark.createDataFrame(_blocks("a", "x", np.ones((2, 2)), 2), PARAMS).drop("shape")
    with pytest.raises(Exception, match="the base lacks block 1 of x"):
        M.task_vectors(params, params.filter("block_no = 0").drop("model")).collect()


def test_scales_of_configs(spark, tmp_path):
    for name, config in (("a", {"r": 4, "lora_alpha": 8, "base_model_name_or_path": "b"}), ("c", {"r": 4, "lora_alpha": 8, "use_rslora": True})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "adapter_config.json").write_text(json.dumps(config, indent=1))
    got = {r.model: (r.scale, r["rank"], r.base) for r in A.read_scales(spark, {m: str(tmp_path / m) for m in ("a", "c")}).collect()}
    assert got == {"a": (2.0, 4, "b"), "c": (4.0, 4, None)}
