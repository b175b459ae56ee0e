"""Run folders, grids and retention plans."""

import pytest
from pyspark.sql import functions as F

from graftwork.functions.columns import template, typed_template
from graftwork.operators import planning as G
from graftwork.sources import params as P
from graftwork.sources import runs as U


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_summary_columns_are_optional(spark, tmp_path):
    write(tmp_path / "s1/summary/summary.csv", "name,dataset,lr,checkpoint,step,accuracy,perplexity\n"
          "sweep,data/processed/arc_easy,5e-05,checkpoint-10,10.0,0.5,2.0\nbase,data/processed/piqa,,,,0.25,\n")  # fmt: skip
    write(tmp_path / "s2/summary/summary.csv", "name,dataset,accuracy,perplexity\nbase,data/processed/piqa,0.5,1.5\n")
    (tmp_path / "s3").mkdir()
    df = U.read_seeds(spark, [f"{tmp_path}/{s}" for s in ("s1", "s2", "s3")])
    rows = [(r.seed, r["name"], r.task, r.lr, r.checkpoint, r.step, r.accuracy) for r in df.orderBy("seed", "row_id").collect()]
    assert rows == [("s1", "sweep", "arc_easy", 5e-5, "checkpoint-10", 10, 0.5), ("s1", "base", "piqa", None, None, None, 0.25),
                    ("s2", "base", "piqa", None, None, None, 0.5)]
    with pytest.raises(ValueError):
        U.read_seeds(spark, [f"{tmp_path}/s3"])
    with pytest.raises(FileNotFoundError):
        U.read_summary(spark, f"{tmp_path}/s3")


def test_row_order_survives_splits(spark, tmp_path):
    lines = "".join(f"n{i},data/processed/t,0.5,1.0\n" for i in range(20_000))
    write(tmp_path / "s1/summary/summary.csv", "name,dataset,accuracy,perplexity\n" + lines)
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in (size, cost)}
    try:
        spark.conf.set(size, "50000")
        spark.conf.set(cost, "1")
        df = U.read_summary(spark, f"{tmp_path}/s1")
        assert df.rdd.getNumPartitions() > 4
        assert [r["name"] for r in df.orderBy("row_id").collect()] == [f"n{i}" for i in range(20_000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v.rstrip("b") if k == size else v)


def test_timing_booleans(spark, tmp_path):
    write(tmp_path / "s1/timing.csv", "stage,job,subjob,job_type,elapsed_s,cached\ntrain,train_a_5e-05,train_a_5e-05_train,train,1.5,False\nmerge,merge_a,,merge,0.0,True\n")
    rows = [(r.seed, r.job, r.elapsed_s, r.cached) for r in U.read_timing(spark, f"{tmp_path}/s1").orderBy("row_id").collect()]
    assert rows == [("s1", "train_a_5e-05", 1.5, False), ("s1", "merge_a", 0.0, True)]


def test_discover_runs(spark, tmp_path):
    yaml = "experiment_name: {e}\nstages:\n  analysis:\n    config:\n      group: {g}\n"
    write(tmp_path / "b_seed1/pipeline.yaml", yaml.format(e="b", g="lora"))
    write(tmp_path / "a_seed2/pipeline.yaml", yaml.format(e='"a"', g="fullft"))
    write(tmp_path / "a_seed1/pipeline.yaml", yaml.format(e="a", g="fullft"))
    write(tmp_path / "c/pipeline.yaml", "experiment_name: c\n")
    found = lambda g: [(r.experiment, r.run_dir.rsplit("/", 1)[1]) for r in U.discover_runs(spark, str(tmp_path), g).collect()]
    assert found("all") == [("a", "a_seed1"), ("a", "a_seed2"), ("b", "b_seed1")]
    assert found("lora") == [("b", "b_seed1")]


def test_params_round_trip_prunes_models(spark, tmp_path):
    df = spark.createDataFrame([("m0", "t", 0, [1.0]), ("m1", "t", 0, [2.0])], "target string, tensor string, block_no bigint, values_ array<float>")
    P.write_params(df, f"{tmp_path}/p")
    back = P.read_params(spark, f"{tmp_path}/p", ["m1"])
    assert [(r.model, r.values_) for r in back.collect()] == [("m1", [2.0])]
    with pytest.raises(FileNotFoundError):
        P.read_params(spark, f"{tmp_path}/missing")


def test_grid_and_resume(spark):
    jobs = G.grid(spark, {"task": ["a", "b"], "lr": ["5e-05", "1e-4"]}, "train")
    assert {r.job for r in jobs.collect()} == {"train_a_5e-05", "train_a_1e-4", "train_b_5e-05", "train_b_1e-4"}
    parts = spark.createDataFrame([("train_a_5e-05", True), ("train_a_5e-05", True), ("train_b_1e-4", True), ("train_b_1e-4", False)], "job string, done boolean")
    done = G.done_jobs(parts)
    assert {r.job for r in G.finished(jobs, done).collect()} == {"train_a_5e-05"}
    assert G.pending(jobs, done).count() == 3


def test_templates(spark):
    df = spark.createDataFrame([("a", 0.25)], "task string, lr double")
    v = {"task": "task", "lr": "lr"}
    r = df.select(template("x_{task}_{lr}_{other}", v).alias("s"), typed_template("{lr}", v).alias("n")).first()
    assert r.s == "x_a_0.25_{other}" and r.n == 0.25


def test_retention(spark):
    art = spark.createDataFrame([("lora_a_lr1", True, 10), ("lora_a_lr2", True, 20), ("lora_f_lr1", False, 5), ("keep", True, 1)], "path string, is_dir boolean, bytes bigint")
    links = spark.createDataFrame([("lora_a", "lora_a_lr2"), ("other", "keep")], "name string, target string")
    plan = G.retention_plan(art, links, ["lora_*_lr*", "*_lr1"])
    assert {r.path for r in plan.collect()} == {"lora_a_lr1"}
    freed = G.retention_summary(G.retention_plan(art, links, ["lora_*"], unlink=["lora_*"])).first()
    assert (freed.removed, freed.bytes) == (2, 30) and freed.gib == 30 / 2**30
    assert G.retention_summary(art.filter(F.lit(False))).first().bytes == 0


def test_wide_and_differing_headers(spark, tmp_path):
    extra = ",".join(f"x{i}" for i in range(90))
    write(tmp_path / "a b/summary/summary.csv", f"{extra},name,dataset,accuracy,step\n" + ",".join("7" * 90) + ",base,data/processed/t,0.5,10.0\n")
    write(tmp_path / "s[2]/summary/summary.csv", "accuracy,,name,name,dataset\n0.25,i,merged,other,data/processed/u\n")
    write(tmp_path / "s3/summary/summary.csv", "accuracy,name,dataset\n")
    write(tmp_path / "s4/summary/summary.csv", "")
    df = U.read_seeds(spark, [f"{tmp_path}/{s}" for s in ("a b", "s[2]", "s3", "s4")])
    rows = [(r.seed, r["name"], r.task, r.accuracy, r.step) for r in df.orderBy("seed").collect()]
    assert rows == [("a b", "base", "t", 0.5, 10), ("s[2]", "merged", "u", 0.25, None)]
    assert U.read_seeds(spark, [f"{tmp_path}/s4"]).collect() == []


@pytest.mark.parametrize("line", ["base,data/processed/t,0.5,9,9", "base,data/processed/t", "base,data/processed/t,high,9"])
def test_lines_that_do_not_fit_fail(spark, tmp_path, line):
    write(tmp_path / "s1/summary/summary.csv", f"name,dataset,accuracy,perplexity\nbase,data/processed/t,0.5,1\n{line}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        U.read_summary(spark, f"{tmp_path}/s1").collect()


def test_filters_on_every_typed_column(spark, tmp_path):
    write(tmp_path / "s1/summary/summary.csv", "name,dataset,lr,checkpoint,step,accuracy,perplexity\nb,data/processed/t,5e-05,final,10.0,0.5,2.0\n")
    write(tmp_path / "s1/timing.csv", "stage,job,subjob,job_type,elapsed_s,cached\ntrain,a,,train,1.5,False\n")
    df = U.read_summary(spark, f"{tmp_path}/s1")
    for condition in ("lr < 1", "step = 10", "accuracy > 0", "perplexity = 2", "lr < 1 AND step > 1 AND accuracy > 0", "step IS NOT NULL"):
        assert df.join(df.select("name").distinct(), "name").filter(condition).count() == 1, condition
    timing = U.read_timing(spark, f"{tmp_path}/s1")
    assert timing.filter("elapsed_s > 1 AND NOT cached").count() == 1


def test_runs_of_several_roots_keep_their_names(spark, tmp_path):
    for root, name, accuracy in (("a", "A", 0.1), ("b", "B", 0.2)):
        write(tmp_path / root / "s1/summary/summary.csv", f"name,dataset,accuracy\nbase,data/processed/t,{accuracy}\nm,data/processed/t,{accuracy}\n")
        write(tmp_path / root / "s1/pipeline.yaml", f"experiment_name: {name}\nstages:\n  analysis:\n    config:\n      group: lora\n")
    found = U.discover_runs(spark, f"{tmp_path}/a").union(U.discover_runs(spark, f"{tmp_path}/b"))
    metrics, timing = U.load_runs(spark, found)
    assert sorted((r.experiment, r.seed, r.accuracy) for r in metrics.collect()) == [("A", "s1", 0.1)] * 2 + [("B", "s1", 0.2)] * 2
    assert timing is None


def test_many_runs_from_one_write_job(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('run ', id % 100) AS run", "'base' AS name", "'data/processed/t' AS dataset", "id / 300 AS accuracy")
    dirs = U.write_runs(rows, f"{tmp_path}/all", "summary/summary.csv")
    assert len(dirs) == 100
    back = U.read_seeds(spark, dirs).groupBy("seed").count().collect()
    assert {r.seed for r in back} == {f"run {k}" for k in range(100)} and {r["count"] for r in back} == {3}
    with pytest.raises(FileExistsError):
        U.write_runs(rows, f"{tmp_path}/all", "summary/summary.csv")


YAMLS = [
    ("experiment_name: 'a # b'  # c\nstages:\n  analysis:\n    config:\n      group: lora # x\n","a # b","lora"),
    ("experiment_name: \"q: \\\"z\\\"\"\nstages: {analysis: {config: {group: lora, n: [1, {group: no}]}}}\n",'q: "z"',"lora"),
    ("---\n# c\nexperiment_name: a#b\nstages:\n  train: {group: wrong}\n  analysis:\n    config: {x: 1,\n      group: 'full # ft' } # t\n","a#b","full # ft"),
    ("name: &n my run\nexperiment_name: *n\nstages:\n  analysis:\n    steps:\n    - group: wrong\n      config: 1\n    config:\n      note: |\n        group: wrong\n      group: ok\n","my run","ok"),
    ("stages:\n  other:\n    group: wrong\n",None,None),
    ("experiment_name:\nstages:\n  analysis:\n    config:\n      group: null\n",None,None),
    ("\"experiment_name\" : x-1\nstages:\n    analysis :\n        config:\n            group : 'it''s'\n","x-1","it's"),
    ("{experiment_name: top, stages: {analysis: {config: {group: a b}}}}\n","top","a b"),
    ("experiment_name: http://x/y\nstages:\n  analysis:\n    config: &c\n      group: g\n","http://x/y","g"),
    ("",None,None),("{",None,None),("]]}: x",None,None),
]


@pytest.mark.parametrize(("text", "name", "group"), YAMLS)
def test_values_of_run_descriptions(text, name, group):
    assert U.yaml_value(text, "experiment_name") == name
    assert U.yaml_value(text, "stages", "analysis", "config", "group") == group
