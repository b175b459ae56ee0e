"""Whole flows on small run folders."""

import pytest

from graftwork.operators import reports as R
from graftwork.plans import flows

PIPELINE = {
    "experiment_name": "m",
    "stages": {"analysis": {"config": {
        "group": "lora",
        "methods": {"base": {"name": "base", "display": "Base"}, "from_scratch": {"name": "tl", "display": "S", "checkpoint": "final"},
                    "merged": {"name": "ml", "display": "M"}, "warm": {"name": "tm", "display": "W", "checkpoint": "final"}},
        "sweeps": {"from_scratch": "sl", "warm": "sm"},
        "timing_stages": {"train": "tr", "relevance": "re", "merge": "me", "train_merged": "tw"},
    }}},
}
HEADER = "name,dataset,lr,checkpoint,step,accuracy,perplexity\n"
SUMMARY = """base,data/processed/a,,,,0.1,1
tl,data/processed/a,,final,,0.5,1
ml,data/processed/a,,,,0.4,1
tm,data/processed/a,,checkpoint-10,10,0.5,1
tm,data/processed/a,,checkpoint-20,20,0.6,1
tm,data/processed/a,,final,,0.6,1
sl,data/processed/a,5e-05,checkpoint-10,10,0.2,1
sl,data/processed/a,5e-05,final,,0.5,1
sm,data/processed/a,5e-05,checkpoint-10,10,0.5,1
sm,data/processed/a,5e-05,final,,0.6,1
"""
TIMING = """stage,job,subjob,job_type,elapsed_s,cached
tr,tr_a_5e-05,tr_a_5e-05_train,train,100,False
re,re_b_a,,eval,5,False
me,me_a,,merge,1,False
tw,tw_a_5e-05,tw_a_5e-05_train,train,60,False
"""


@pytest.fixture
def run_dirs(tmp_path):
    for seed in ("s1", "s2"):
        (tmp_path / seed / "summary").mkdir(parents=True)
        (tmp_path / seed / "summary" / "summary.csv").write_text(HEADER + SUMMARY)
    (tmp_path / "s1" / "timing.csv").write_text(TIMING)
    return [str(tmp_path / s) for s in ("s1", "s2", "missing")]


def test_analysis_of_a_model(spark, run_dirs, tmp_path):
    cfg = flows.report_config(PIPELINE)
    assert [m.role for m in cfg.methods] == ["base", "from_scratch", "merged", "from_merged"]
    tables = flows.analyze_model(spark, run_dirs, cfg, "m")
    cell = tables["results"].filter("role = 'from_merged' AND task = 'a'").first()
    assert cell["mean"] == pytest.approx(60) and cell["is_best"] and cell["n_seeds"] == 2
    assert tables["speedup"].filter("task = 'a'").first()["mean"] == pytest.approx(50)
    t = tables["timing"].filter("task = 'a'").first()
    # Only s1 has timings: 5 + 1 + 60 * 50%.
    assert (t.scratch_s, t.reuse_s, t.ratio) == (100, 36, 0.36)
    assert tables["training_curves"].count() == 4 and tables["lr_sensitivity"].count() == 4
    flows.write_tables({"results": tables["results"]}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/results.csv")).count() == 8


def test_config_section_is_required():
    with pytest.raises(ValueError):
        flows.report_config({"stages": {}})
    with pytest.raises(ValueError):
        flows.analyze_model(None, [], R.ReportConfig())


def test_select_and_merge(spark):
    docs = spark.createDataFrame([(f"e{i}", f"m{i}", "t", i / 10) for i in range(4)], "eval_dir string, model string, target_task string, accuracy double")
    params = spark.createDataFrame([(f"m{i}", "x", 0, [float(i)]) for i in range(4)], "model string, tensor string, block_no bigint, values_ array<float>")
    best, merged = flows.select_and_merge(docs, params)
    assert [r.model for r in best.orderBy("rank").collect()] == ["m3", "m2"]
    assert merged.first().values_ == [2.5]
