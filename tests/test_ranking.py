"""Ranking ties, weights and documents on disk."""

import json

import pytest
from pyspark.sql import functions as F

from graftwork.functions import columns as C
from graftwork.operators import ranking as R
from graftwork.sources import evaluations as E

DOCS = "eval_dir string, model string, target_task string, accuracy double, nll double"


def docs(spark):
    rows = [
        ("eval_c_on_t", "c", "t", 0.5, 2.0), ("eval_a_on_t", "a", "t", 0.5, 1.0), ("eval_b_on_t", "b", "t", 0.9, 0.0),
        ("eval_d_on_t", "d", "t", None, 4.0), ("eval_e_on_u", "e", "u", 0.1, 1.0), ("eval_x", "x", None, 0.3, 1.0),
    ]
    return spark.createDataFrame(rows, DOCS)


def order(df, key="t"):
    return [r.model for r in df.filter(F.col("target_task") == key).orderBy("rank").collect()]


def test_ties_keep_name_order_in_both_directions(spark):
    assert order(R.rank_models(docs(spark))) == ["b", "a", "c"]
    assert order(R.rank_models(docs(spark), "nll")) == ["b", "a", "c", "d"]


@pytest.mark.parametrize("metric", ["accuracy", "nll"])
def test_topk_is_a_prefix_of_the_ranking(spark, metric):
    full = order(R.rank_models(docs(spark), metric))
    for k in (1, 2, 9):
        best = R.select_topk(docs(spark), k, metric)
        assert order(best) == full[:k]
        assert best.filter("target_task = 't'").first().num_candidates == len(full)


def test_missing_target_is_its_own_group(spark):
    best = R.select_topk(docs(spark), 2).filter("target_task = ''").collect()
    assert [r.model for r in best] == ["x"] and best[0].num_candidates == 1


def test_weights(spark):
    equal = {r.model: r.weight for r in R.select_topk(docs(spark), 2).filter("target_task = 't'").collect()}
    assert equal == {"b": 1.0, "a": 1.0}
    prop = {r.model: r.weight for r in R.select_topk(docs(spark), 2, "accuracy", "proportional").filter("target_task = 't'").collect()}
    assert prop == {"b": 0.9, "a": 0.5}
    inverse = {r.model: r.weight for r in R.select_topk(docs(spark), 3, "nll", "proportional").filter("target_task = 't'").collect()}
    # A score of zero gets no weight; the largest selected score is 2.
    assert inverse == {"b": 0.0, "a": 2.0, "c": 1.0}


def test_glob_matches_like_a_shell(spark):
    names = ["eval_a_on_b", "eval_on_b", "xeval_a_on_b", "eval_a_on_bb", "eval_[1]_on_b", "a.b", "axb", "a\nb"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    hit = lambda *p: {r.n for r in df.filter(C.matches_any("n", list(p))).collect()}
    assert hit("eval_*_on_b") == {"eval_a_on_b", "eval_[1]_on_b"}
    assert hit("a.b") == {"a.b"} and hit("a?b") == {"a.b", "axb", "a\nb"}
    assert hit("eval_[[]1]_on_b") == {"eval_[1]_on_b"} and hit("a[!x]b") == {"a.b", "a\nb"}
    assert hit("eval_on*", "axb") == {"eval_on_b", "axb"} and hit() == set()


def test_parse_lr(spark):
    names = {"lora_t_lr5e-05": 5e-5, "lora_t_lr0.00016": 0.00016, "x_lr5.0E-4": 5e-4, "lora_t": None, "a_lr1_b": 1.0}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.v for r in df.select("n", C.parse_lr("n").alias("v")).collect()} == names


def result(path, **fields):
    path.mkdir(parents=True)
    base = {"accuracy": 0.5, "model": "runs/lora_t", "dataset": "data/processed/t"}
    (path / E.RESULT_FILE).write_text(json.dumps({**base, **fields}, indent=2))


def test_reading_result_documents(spark, tmp_path):
    result(tmp_path / "eval_lora_t_lr5e-05", accuracy=0.7, checkpoint="final", step=None)
    result(tmp_path / "eval_lora_t_lr5e-05" / "checkpoint-10", accuracy=0.6, checkpoint="checkpoint-10", step=10)
    result(tmp_path / "eval_base_t", perplexity=3.0)
    (tmp_path / "eval_empty").mkdir()
    (tmp_path / "eval_link").symlink_to(tmp_path / "eval_base_t")
    top = E.read_eval_results(spark, str(tmp_path), "eval_*")
    assert {r.eval_dir for r in top.collect()} == {"eval_lora_t_lr5e-05", "eval_base_t", "eval_link"}
    every = E.read_eval_results(spark, str(tmp_path), "eval_*", include_checkpoints=True)
    assert {(r.eval_dir, r.checkpoint_dir, r.step) for r in every.collect()} == {
        ("eval_lora_t_lr5e-05", "checkpoint-10", 10), ("eval_lora_t_lr5e-05", None, None),
        ("eval_base_t", None, None), ("eval_link", None, None),
    }
    with pytest.raises(FileNotFoundError):
        E.read_eval_results(spark, str(tmp_path), "nothing_*")

    entries = [E.SummaryEntry("sweep", "eval_lora_*_lr*"), E.SummaryEntry("final_only", "eval_lora_*", include_checkpoints=False),
               E.SummaryEntry("own", "eval_base_*", self_eval_only=True), E.SummaryEntry("none", "zzz*")]
    rows = [(r.name, r.lr, r.checkpoint, r.step) for r in E.build_summary(every, entries).collect()]
    assert sorted(rows, key=str) == sorted(
        [("sweep", 5e-5, "final", None), ("sweep", 5e-5, "checkpoint-10", 10), ("final_only", 5e-5, "final", None),
         ("own", None, None, None)], key=str)
    with pytest.warns(UserWarning, match="none"):
        assert E.unmatched_entries(every, entries) == ["none"]
    assert R.candidates(top, "perplexity").count() == 2
