"""Hand-computed token metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graftwork.operators import tokens as K

SCHEMA = "m string, sample_id bigint, pos bigint, label_id bigint, pred_id bigint, nll double, is_special boolean"


def tokens(spark):
    rows = [
        # sample 0: right, plus a special token that only counts for the loss
        ("a", 0, 0, -100, 9, 9.0, False), ("a", 0, 1, 5, 5, 1.0, False), ("a", 0, 2, 1, 7, 3.0, True),
        # sample 1: one of two right
        ("a", 1, 0, -100, 9, 9.0, False), ("a", 1, 1, 6, 6, 2.0, False), ("a", 1, 2, 7, 8, 6.0, False),
        # sample 2: nothing but prompt
        ("a", 2, 0, -100, 9, 9.0, False),
        # sample 3: right
        ("a", 3, 1, 4, 4, 0.5, False),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_metrics_by_hand(spark):
    r = one(K.evaluate(tokens(spark), ["m"], batch_size=2))
    assert r["accuracy"] == 0.75 and r["num_answer_tokens"] == 4
    assert r["exact_match"] == 0.5 and r["num_samples"] == 4
    # Batches: (1 + 3 + 2 + 6) / 4 = 3 and 0.5 / 1; the mean is over batches.
    assert r["nll"] == 1.75
    assert r["perplexity"] == round(float(np.exp(np.float32(1.75), dtype=np.float32)), 4)


def test_nll_depends_on_the_batch_size(spark):
    by_size = {n: one(K.batch_nll(tokens(spark), n, ["m"]))["nll"] for n in (1, 2, 4)}
    assert by_size == {1: round((2 + 4 + 0.5) / 3, 6), 2: 1.75, 4: 2.5}


def test_samples_without_tokens_count(spark):
    samples = spark.createDataFrame([("a", i) for i in range(8)], "m string, sample_id bigint")
    r = one(K.evaluate(tokens(spark), ["m"], 2, samples=samples))
    assert r["num_samples"] == 8 and r["exact_match"] == 0.25
    assert one(K.exact_match(tokens(spark), ["m"], samples))["exact_match"] == 0.25


def test_no_answer_tokens_gives_zero(spark):
    only_prompt = tokens(spark).filter("label_id = -100")
    r = one(K.evaluate(only_prompt, ["m"], 2))
    assert (r["accuracy"], r["exact_match"], r["nll"], r["perplexity"]) == (0.0, 0.0, 0.0, 1.0)


def test_early_stop_keeps_the_failing_batch_and_all_samples(spark):
    r = one(K.evaluate(tokens(spark), ["m"], 1, min_accuracy=0.9))
    # Sample 0 passes (1/1), sample 1 fails (2/3) and still counts.
    assert r["accuracy"] == round(2 / 3, 6) and r["num_answer_tokens"] == 3
    assert r["exact_match"] == 0.25 and r["num_samples"] == 4
    assert r["nll"] == 3.0


@pytest.mark.parametrize("off", [None, 0.0])
def test_zero_threshold_is_off(spark, off):
    assert one(K.evaluate(tokens(spark), ["m"], 1, min_accuracy=off))["num_answer_tokens"] == 4


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitioning_does_not_matter(spark, parts):
    big = spark.range(4_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.lit(None)).alias("m"),
        F.floor(F.col("id") / 4).alias("sample_id"), (F.col("id") % 4).alias("pos"),
        (F.col("id") % 11).alias("label_id"), (F.col("id") % 7).alias("pred_id"),
        (F.col("id") % 8 / 8).alias("nll"), (F.col("id") % 13 == 0).alias("is_special"),
    )
    want = {r["m"]: r.asDict() for r in K.evaluate(big, ["m"], 16, min_accuracy=0.05).collect()}
    got = {r["m"]: r.asDict() for r in K.evaluate(big.repartition(parts), ["m"], 16, min_accuracy=0.05).collect()}
    assert want == got and set(want) == {"hot", None}


def test_order_is_required(spark):
    with pytest.raises(ValueError):
        K.with_batches(tokens(spark), 2, ["m"], [])
    with pytest.raises(ValueError):
        K.head_samples(tokens(spark), 2, ["m"], [])


def test_trim_never_enters_the_prompt_and_stops_at_content(spark):
    rows = [(1, 0, 50), (1, 1, 51), (1, 2, 60), (1, 3, 0), (1, 4, 61), (1, 5, 5), (1, 6, 0), (2, 0, 50), (2, 1, 0), (2, 2, 5)]
    df = spark.createDataFrame(rows, "sample_id bigint, pos bigint, label_id bigint")
    vocab = spark.createDataFrame([(0, True, False), (5, False, True), (60, False, False)], "id bigint, is_special boolean, is_blank boolean")
    out = {(r.sample_id, r.pos): r.trimmed_label for r in K.trim_trailing(df, vocab, ["sample_id"], F.lit(1)).collect()}
    assert [out[(1, i)] for i in range(7)] == [-100, 51, 60, 0, 61, -100, -100]
    assert [out[(2, i)] for i in range(3)] == [-100, -100, -100]


def test_mask_prompt(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    assert df.select(K.mask_prompt("ids", F.lit(2)).alias("x")).first().x == [-100, -100, 3]


def test_checkpoint_names(spark):
    names = ["r/checkpoint-9", "r/checkpoint-100", "r/checkpoint-1x", "r/mycheckpoint-3", "r/final", "checkpoint-20"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r.step for r in K.discover_checkpoints(df).collect()] == [9, 20, 100]


def test_perplexity_of_a_large_loss(spark):
    out = spark.range(1).select(K.perplexity(F.lit(20.0)).alias("p")).first().p
    assert math.isclose(out, math.exp(20), rel_tol=1e-6)
