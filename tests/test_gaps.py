"""Inputs with gaps: merges fail, stores keep their models, reports use their own tasks."""

import pytest
from pyspark.sql import functions as F

from graftwork.operators import merging as M
from graftwork.operators import planning as G
from graftwork.operators import reports as R
from graftwork.operators import timing as T
from graftwork.plans import flows
from graftwork.sources import datasets, evaluations, params, runs

PARAMS = "model string, tensor string, block_no bigint, values_ array<float>, shape array<bigint>"
RECIPE = "target string, model string, ord bigint, weight double, density double"


def _params(spark, blocks):
    return spark.createDataFrame([(m, t, i, [1.0 * (k + 1), 2.0], [2, 1]) for k, (m, t, i) in enumerate(blocks)], PARAMS)


FULL = [(m, t, i) for m in ("a", "b") for t in ("q", "r") for i in (0, 1)]
PAIR = [("t", "a", 0, 1.0, 1.0), ("t", "b", 1, 1.0, 1.0)]


@pytest.mark.parametrize("method", M.METHODS)
def test_absent_model_fails(spark, method):
    p = _params(spark, FULL)
    base = p.filter("model = 'a'").drop("model")
    for order in (PAIR[:1] + [("t", "gone", 1, 1.0, 1.0)], [("t", "gone", 0, 1.0, 1.0), ("t", "b", 1, 1.0, 1.0)]):
        with pytest.raises(ValueError, match="gone: no parameters"):
            M.merge(method, p, spark.createDataFrame(order, RECIPE), base)


@pytest.mark.parametrize("method", M.METHODS)
def test_absent_block_fails(spark, method):
    p = _params(spark, [x for x in FULL if x != ("b", "r", 1)])
    base = _params(spark, FULL).filter("model = 'a'").drop("model")
    with pytest.raises(Exception, match="lack"):
        M.merge(method, p, spark.createDataFrame(PAIR, RECIPE), base).collect()


@pytest.mark.parametrize("method", [M.TIES, M.DARE_TIES])
def test_block_without_base_fails(spark, method):
    p = _params(spark, FULL)
    base = p.filter("model = 'a' AND NOT (tensor = 'r' AND block_no = 1)").drop("model")
    with pytest.raises(Exception, match="the base lacks block 1 of r"):
        M.merge(method, p, spark.createDataFrame(PAIR, RECIPE), base).collect()


def test_merge_entry(spark):
    p = _params(spark, [*FULL, ("a", "embed_tokens", 0), ("b", "embed_tokens", 0)])
    recipe = spark.createDataFrame(PAIR, RECIPE).withColumn("is_adapter", F.lit(True))
    kept = {m: {r.tensor for r in M.merge(m, p, recipe, p.filter("model = 'a'").drop("model")).collect()} for m in M.METHODS}
    assert kept[M.AVERAGE] == {"q", "r", "embed_tokens"}
    assert kept[M.LINEAR] == kept[M.TIES] == kept[M.DARE_TIES] == {"q", "r"}
    assert all(r.shape == [2, 1] for r in M.merge(M.LINEAR, p, recipe).collect())
    other = p.withColumn("shape", F.when(F.col("model") == "b", F.array(F.lit(1).cast("bigint"))).otherwise(F.col("shape")))
    with pytest.raises(ValueError, match="shape"):
        M.merge(M.LINEAR, other, recipe)
    with pytest.raises(ValueError, match="unknown"):
        M.merge("best", p, recipe)
    with pytest.raises(ValueError, match="base"):
        M.merge(M.TIES, p, recipe)


def test_merge_gaps(spark):
    p = _params(spark, [x for x in FULL if x != ("b", "r", 1)])
    base = _params(spark, [("x", "q", 0), ("x", "r", 0), ("x", "r", 1)])
    rows = [*PAIR, ("u", "a", 0, 1.0, 1.0), ("u", "gone", 1, 1.0, 1.0)]
    got = {tuple(r) for r in M.merge_gaps(spark.createDataFrame(rows, RECIPE), p, base).collect()}
    assert got == {
        ("t", "b", "r", 1, "no such block"),
        ("u", "gone", None, None, "no parameters"),
        ("t", "base", "q", 1, "no such block"),
        ("u", "base", "q", 1, "no such block"),
    }


def test_write_params_keeps_other_models(spark, tmp_path):
    path = str(tmp_path / "p")
    params.write_params(_params(spark, FULL), path)
    params.write_params(_params(spark, [("x", "q", 0)]).withColumnRenamed("model", "target"), path, "target")
    params.write_params(_params(spark, [("b", "q", 0)]).drop("shape"), path)
    got = sorted((r.model, r.tensor, r.block_no, r.shape is None) for r in params.read_params(spark, path).collect())
    assert got == [("a", "q", 0, False), ("a", "q", 1, False), ("a", "r", 0, False), ("a", "r", 1, False), ("b", "q", 0, True), ("x", "q", 0, False)]


def test_splits_beyond_a_thousand(spark, tmp_path):
    rows = spark.range(3000).select(F.format_string("s%05d", "id").alias("split"), "id")
    assert datasets.pick_eval_split(rows, "s02999").count() == 1
    with pytest.raises(ValueError, match="dev"):
        datasets.pick_eval_split(rows, "dev")
    small = spark.createDataFrame([(1, "test"), (2, "train"), (3, "validation")], "id int, split string")
    datasets.write_dataset(small, str(tmp_path / "d"), ["train", "test"])
    order = datasets.split_order(spark, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert order == ["train", "test"] and back.count() == 3
    assert datasets.pick_eval_split(back, order=order).first()["id"] == 2
    assert datasets.pick_eval_split(back).first()["id"] == 1
    datasets.write_dataset(small, str(tmp_path / "e"))
    assert datasets.split_order(spark, str(tmp_path / "e")) == []


def test_broken_documents_fail(spark, tmp_path):
    for name, text in (("eval_a", '{"accuracy": 0.5}'), ("eval_b", '{"accuracy": 0.7, ')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "eval_results.json").write_text(text)
    assert evaluations.read_eval_results(spark, str(tmp_path), "eval_a").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        evaluations.read_eval_results(spark, str(tmp_path), "eval_*").collect()


def test_row_ids_follow_part_files(spark, tmp_path):
    rows = spark.range(40).select(F.lit("n").alias("name"), F.lit("d").alias("dataset"), F.col("id").cast("double").alias("step"), F.lit(0.5).alias("accuracy"))
    evaluations.write_csv(rows.repartitionByRange(4, "step").sortWithinPartitions("step"), f"{tmp_path}/summary/summary.csv")
    got = [r.step for r in runs.read_summary(spark, str(tmp_path)).orderBy("row_id").collect()]
    assert got == list(range(40))


def test_group_comes_from_the_analysis(spark, tmp_path):
    text = "experiment_name: e\nstages:\n  other:\n    group: wrong\n  analysis:\n    config:\n      group: 'lora'  # note\n"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "pipeline.yaml").write_text(text)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "pipeline.yaml").write_text("stages:\n  other:\n    group: wrong\n")
    assert [(r.experiment, r.group) for r in runs.discover_runs(spark, str(tmp_path)).collect()] == [("e", "lora")]


def test_extra_roles_keep_their_names():
    method = {"name": "n", "display": "d"}
    config = {"group": "g", "methods": {"base": method, "x": method, "y": method}, "sweeps": {"x": "sx", "y": "sy"}}
    cfg = flows.report_config({"stages": {"analysis": {"config": config}}})
    assert [m.role for m in cfg.methods] == ["base", "x", "y"] and cfg.sweeps == {"x": "sx", "y": "sy"}
    cfg = flows.report_config({"stages": {"analysis": {"config": config}}}, from_merged="y")
    assert [m.role for m in cfg.methods] == ["base", "x", "from_merged"]


def test_retention_resolves_paths(spark):
    rows = [("lora_a", True, 5), ("lora_a/checkpoint-1", True, 2), ("lora_b", True, 7), ("lora_c", True, 1), ("lora_c/best", True, 1), ("lora_d", True, 3), ("x/lora_e", True, 9)]
    artifacts = spark.createDataFrame(rows, "path string, is_dir boolean, bytes bigint")
    links = spark.createDataFrame([("l1", "./lora_b"), ("l2", "x/../lora_c/best/"), ("l3", "lora_d")], "name string, target string")
    plan = G.retention_plan(artifacts, links, ["lora_*", "lora_*/*"], unlink=["l3"])
    assert sorted((r.path, r.bytes) for r in plan.collect()) == [("lora_a", 5), ("lora_d", 3)]


def test_training_jobs_need_their_own_part(spark):
    rows = [("train_t_0.1", "train", "train_t_0.1", "train_t_0.1_train"), ("train_t_0.1", "train", "train_t_0.1", "train_t_0.1_eval")]
    df = spark.createDataFrame([("train", *r[1:]) for r in rows], "stage string, job_type string, job string, subjob string")
    assert sorted((r.subjob, r.lr) for r in T.parse_jobs(df).collect()) == [("train_t_0.1_eval", None), ("train_t_0.1_train", 0.1)]


def test_combined_speedup_averages_own_tasks(spark):
    rows = []
    for e, tasks in (("a", ["t0", "t1"]), ("b", ["t0"]), ("c", ["t0", "t2"])):
        for t in tasks:
            base = [("trained_scratch", "final", 10, 0.8), ("merged", None, None, 0.2)]
            curve = [("trained_merged", f"checkpoint-{s}", s, a) for s, a in ((3, 0.5), (6, 0.8 if t != "t2" else 0.9), (9, 0.9))]
            rows += [(e, "s", "seed0", n, t, None, c, s, x, i) for i, (n, c, s, x) in enumerate(base + curve)]
    m = spark.createDataFrame(rows, "experiment string, setup string, seed string, name string, task string, lr double, checkpoint string, step bigint, accuracy double, row_id bigint")
    cfg = R.ReportConfig()
    got = {(r.experiment, r.task): (r.mean, r.n_seeds) for r in R.combined_speedup(m, cfg).filter("NOT strict").collect()}
    own = {r.experiment: (r["mean"], r.n_seeds) for r in R.speedup_agg(R.training_to_parity(m, cfg)).filter(F.col("task") == R.AVG).collect()}
    assert {e: got[(e, R.AVG)] for e in "abc"} == own
    assert got[("b", R.AVG)] == got[("b", "t0")]
    assert ("c", "t2") not in got and ("b", "t1") not in got


def test_many_runs_with_different_headers(spark, tmp_path):
    for i in range(40):
        d = tmp_path / f"run{i}"
        (d / "summary").mkdir(parents=True)
        if i % 2:
            text = "name,dataset,lr,checkpoint,step,accuracy\nn,data/processed/t,0.1,final,3,0.5\nm,data/processed/u,,,,0.25\n"
        else:
            text = "accuracy,name,dataset\n0.75,n,data/processed/t\n"
        (d / "summary/summary.csv").write_text(text)
        (d / "pipeline.yaml").write_text(f"experiment_name: e{i % 3}\nstages:\n  analysis:\n    config:\n      group: lora\n")
    (tmp_path / "run1/timing.csv").write_text("stage,job,subjob,job_type,elapsed_s,cached\ntrain,train_t_0.1,train_t_0.1_train,train,5.0,false\n")
    dirs = [str(tmp_path / f"run{i}") for i in range(41)]
    rows = runs.read_seeds(spark, dirs).collect()
    assert len(rows) == 60
    got = {(r.seed, r.name): (r.accuracy, r.lr, r.step, r.task) for r in rows}
    assert got[("run1", "n")] == (0.5, 0.1, 3, "t") and got[("run1", "m")] == (0.25, None, None, "u")
    assert got[("run2", "n")] == (0.75, None, None, "t")
    metrics, timing = runs.load_runs(spark, runs.discover_runs(spark, str(tmp_path)))
    assert metrics.count() == 60 and {r.experiment for r in metrics.collect()} == {"e0", "e1", "e2"}
    assert [(r.seed, r.experiment, r.elapsed_s, r.cached) for r in timing.collect()] == [("run1", "e1", 5.0, False)]
    with pytest.raises(ValueError, match="no valid"):
        runs.read_seeds(spark, [str(tmp_path / "none")])
