"""Properties and brute-force checks of the parameter algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graftwork.functions import blocks as B
from graftwork.operators import merging as M
from graftwork.operators.sparsify import trim

PARAMS = "model string, tensor string, block_no bigint, values_ array<float>"
RECIPE = "target string, model string, ord bigint, weight double, density double"


def params(spark, models):
    rows = [(m, t, i, [float(x) for x in v]) for m, ts in models.items() for t, bs in ts.items() for i, v in enumerate(bs)]
    return spark.createDataFrame(rows, PARAMS)


def recipe(spark, rows):
    return spark.createDataFrame([(t, m, o, float(w), float(d)) for t, m, o, w, d in rows], RECIPE)


def collect(df):
    return {(r.target, r.tensor, r.block_no): np.array(r.values_, np.float32) for r in df.collect()}


@pytest.fixture
def tensors():
    rng = np.random.default_rng(7)
    make = lambda: {"a": rng.normal(size=(3, 16)).astype("f4"), "b": rng.normal(size=(2, 8)).astype("f4")}
    return {"m0": make(), "m1": make(), "m2": make()}, make()


def test_average_of_equal_models_is_the_model(spark, tensors):
    models, _ = tensors
    same = params(spark, {"m0": models["m0"], "m1": models["m0"]})
    out = collect(M.average_params(same, recipe(spark, [("t", "m0", 0, 1, 1), ("t", "m1", 1, 5, 1)])))
    for (_, t, i), v in out.items():
        assert np.array_equal(v, models["m0"][t][i])
    assert len(out) == 5


def test_average_ignores_weights_and_order(spark, tensors):
    models, _ = tensors
    p = params(spark, models)
    a = collect(M.average_params(p, recipe(spark, [("t", "m0", 0, 1, 1), ("t", "m1", 1, 9, 1)])))
    b = collect(M.average_params(p.repartition(7), recipe(spark, [("t", "m1", 0, 2, 1), ("t", "m0", 1, 1, 1)])))
    for k, v in a.items():
        assert np.array_equal(v, b[k])
        want = (models["m0"][k[1]][k[2]].astype("f8") + models["m1"][k[1]][k[2]]) / 2
        assert np.array_equal(v, want.astype("f4"))


def test_average_follows_the_first_models_keys(spark, tensors):
    models, _ = tensors
    short = {"m0": {"a": models["m0"]["a"]}, "m1": models["m1"]}
    pair = [("t", "m0", 0, 1, 1), ("t", "m1", 1, 1, 1)]
    assert {k[1] for k in collect(M.average_params(params(spark, short), recipe(spark, pair)))} == {"a"}
    turned = [("t", "m1", 0, 1, 1), ("t", "m0", 1, 1, 1)]
    with pytest.raises(Exception, match="lacks block"):
        M.average_params(params(spark, short), recipe(spark, turned)).collect()


def test_linear_normalization(spark, tensors):
    models, _ = tensors
    rows = [("t", "m0", 0, 1, 1), ("t", "m1", 1, 3, 1)]
    p = params(spark, models)
    for normalize, den in ((True, 4.0), (False, 1.0)):
        out = collect(M.linear_merge(p, recipe(spark, rows), normalize))
        for (_, t, i), v in out.items():
            want = (models["m0"][t][i].astype("f8") + 3 * models["m1"][t][i].astype("f8")) / den
            assert np.allclose(v, want, rtol=1e-6)


def test_many_targets_and_a_long_recipe(spark):
    rng = np.random.default_rng(1)
    models = {f"m{i}": {"a": rng.normal(size=(2, 4)).astype("f4")} for i in range(150)}
    rows = [("long", f"m{i}", i, 1, 1) for i in range(150)] + [("short", "m3", 0, 1, 1), ("short", "m9", 1, 1, 1)]
    out = collect(M.average_params(params(spark, models), recipe(spark, rows)))
    for b in range(2):
        want = np.mean([m["a"][b].astype("f8") for m in models.values()], axis=0)
        assert np.allclose(out[("long", "a", b)], want, rtol=1e-5, atol=1e-7)


def test_unpinned_recipe_gives_the_same(spark, tensors, monkeypatch):
    models, base = tensors
    rows = [("t", "m0", 0, 1, 0.5), ("t", "m1", 1, 2, 0.25), ("u", "m2", 0, 1, 1), ("u", "m1", 1, 1, 0.5)]
    p, b = params(spark, models), params(spark, {"x": base}).drop("model")
    want = collect(M.ties_merge(p, b, recipe(spark, rows)))
    monkeypatch.setattr(M, "pinned", lambda df, max_rows=0: None)
    got = collect(M.ties_merge(p, b, recipe(spark, rows)))
    assert want.keys() == got.keys()
    assert all(np.array_equal(want[k], got[k]) for k in want)


def test_large_recipe_spreads_a_hot_model(spark, monkeypatch):
    monkeypatch.setattr(M, "pinned", lambda df, max_rows=0: None)
    monkeypatch.setattr(M, "SHARES", 8)
    blocks = spark.range(400).selectExpr("'hot' AS model", "'w' AS tensor", "id AS block_no", "array(float(id)) AS values_")
    blocks = blocks.unionByName(spark.range(5).selectExpr("'cold' AS model", "'w' AS tensor", "id AS block_no", "array(float(id)) AS values_"))
    rec = spark.range(50).selectExpr("concat('t', id) AS target", "'hot' AS model", "id AS ord")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = M._by_model(blocks, rec)
        assert joined.count() == 400 * 50
        per_task = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) > 2 and max(per_task) < 0.7 * sum(per_task)
        assert M._selected(blocks, None, rec).count() == 400
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def brute_ties(models, base, rows, sparsify):
    out = {}
    for t, blocks in base.items():
        flat_base = np.concatenate(list(blocks)).astype("f8")
        num, den, moved = np.zeros_like(flat_base), np.zeros_like(flat_base), []
        for m, w, d in rows:
            delta = (np.concatenate(list(models[m][t])).astype("f8") - flat_base).astype("f4")
            moved.append((sparsify(m, t, delta, d), w))
        sign = np.sign(sum(x * w for x, w in moved))
        for x, w in moved:
            agree = (np.sign(x) == sign) & (sign != 0)
            num += np.where(agree, x * w, 0)
            den += np.where(agree, w, 0)
        merged = flat_base + num / np.where(np.abs(den) < 1e-8, 1, den)
        for i, part in enumerate(np.split(merged, len(blocks))):
            out[(t, i)] = part.astype("f4")
    return out


def keep_top(m, t, delta, density):
    k = int(np.floor(density * len(delta)))
    kept = np.zeros_like(delta, dtype="f8")
    order = np.lexsort((np.arange(len(delta)), -np.abs(delta)))[:k]
    kept[order] = delta[order]
    return kept


@pytest.mark.parametrize("density", [1.0, 0.6, 0.1, 0.0])
def test_ties_against_brute_force(spark, tensors, density):
    models, base = tensors
    rows = [("m0", 1.0, density), ("m1", 2.0, 1.0), ("m2", 0.5, 0.3)]
    want = brute_ties(models, base, rows, keep_top)
    r = recipe(spark, [("t", m, i, w, d) for i, (m, w, d) in enumerate(rows)])
    out = collect(M.ties_merge(params(spark, models), params(spark, {"x": base}).drop("model"), r))
    assert {k[1:] for k in out} == set(want)
    for (_, t, i), v in out.items():
        assert np.allclose(v, want[(t, i)], rtol=1e-6, atol=1e-7)


def test_ties_with_agreeing_signs_is_base_plus_weighted_mean(spark):
    base = {"a": np.zeros((1, 4), "f4")}
    models = {"m0": {"a": [[1, 2, 3, 4]]}, "m1": {"a": [[3, 2, 1, 4]]}}
    r = recipe(spark, [("t", "m0", 0, 1, 1), ("t", "m1", 1, 3, 1)])
    out = collect(M.ties_merge(params(spark, models), params(spark, {"x": base}).drop("model"), r))
    assert np.allclose(out[("t", "a", 0)], [2.5, 2.0, 1.5, 4.0])


def test_dare_at_density_one_is_ties_and_mask_is_stable(spark, tensors):
    models, base = tensors
    p, b = params(spark, models), params(spark, {"x": base}).drop("model")
    full = [("t", "m0", 0, 1, 1), ("t", "m1", 1, 2, 1)]
    a, c = collect(M.ties_merge(p, b, recipe(spark, full))), collect(M.dare_ties_merge(p, b, recipe(spark, full), 3))
    assert all(np.array_equal(a[k], c[k]) for k in a)
    part = [("t", "m0", 0, 1, 0.4), ("t", "m1", 1, 2, 0.4)]
    one = collect(M.dare_ties_merge(p.repartition(1), b, recipe(spark, part), 3))
    many = collect(M.dare_ties_merge(p.repartition(9), b.repartition(5), recipe(spark, part), 3))
    other = collect(M.dare_ties_merge(p, b, recipe(spark, part), 4))
    assert all(np.array_equal(one[k], many[k]) for k in one)
    assert any(not np.array_equal(one[k], other[k]) for k in one)


def test_dare_keeps_about_the_density(spark):
    row = {"density": 0.3, "model": "m", "tensor": "t", "block_no": 0}
    kept = B.drop_at_random(row, np.ones(65_536, "f4"), 1)
    assert abs((kept != 0).mean() - 0.3) < 0.01
    assert np.allclose(kept[kept != 0], 1 / 0.3)


@pytest.mark.parametrize("density", [0.0, 0.2, 0.5, 0.77, 1.0])
def test_trim_keeps_exactly_the_largest_with_ties(spark, density):
    rng = np.random.default_rng(3)
    # A third of all values are the same magnitude, some are zero.
    values = rng.choice([0.0, 0.5, -0.5, 0.5, 1.25, -2.0, 3e-39], size=(40, 33)).astype("f4")
    rows = [("m", "t", density, i, [float(x) for x in v]) for i, v in enumerate(values)]
    rows += [("n", "t", density, i, [float(x) for x in -v]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "model string, tensor string, density double, block_no bigint, delta array<float>")
    flat = values.reshape(-1)
    want = keep_top("m", "t", flat, density)
    for n in (1, 7):
        out = {(r.model, r.block_no): np.array(r.delta, "f4") for r in trim(df.repartition(n)).collect()}
        got = np.concatenate([out[("m", i)] for i in range(40)])
        assert np.array_equal(got, want.astype("f4"))
        assert np.array_equal(-np.concatenate([out[("n", i)] for i in range(40)]), want.astype("f4"))


def test_trim_with_a_group_larger_than_one_block_chunk(spark):
    values = np.ones((5_000, 2), "f4")
    rows = [("m", "t", 0.9, i, [1.0, 1.0]) for i in range(len(values))]
    df = spark.createDataFrame(rows, "model string, tensor string, density double, block_no bigint, delta array<float>")
    kept = trim(df).select(F.col("block_no"), F.explode("delta").alias("x")).filter("x <> 0")
    assert kept.count() == 9_000
    assert kept.agg(F.max("block_no")).first()[0] == 4_499


def test_recipe_checks(spark, tensors):
    models, _ = tensors
    p = params(spark, models)
    good = recipe(spark, [("t", "m0", 0, 1, 1), ("t", "m1", 1, 1, 1)])
    assert M.validate_recipe(good, p) is good
    with pytest.raises(ValueError, match="fewer than 2"):
        M.validate_recipe(recipe(spark, [("t", "m0", 0, 1, 1)]), p)
    with pytest.raises(ValueError, match="no parameters"):
        M.validate_recipe(recipe(spark, [("t", "m0", 0, 1, 1), ("t", "zz", 1, 1, 1)]), p)


def test_strip_embeddings_keeps_factors(spark):
    names = ["embed_tokens.weight", "lm_head.weight", "lm_head.lora_A", "embed_tokens.lora_B", "layers.0.q"]
    df = spark.createDataFrame([("m", n, 0, [1.0]) for n in names], PARAMS)
    assert {r.tensor for r in M.strip_embeddings(df).collect()} == set(names[2:])
