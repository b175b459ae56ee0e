"""Hand-computed reports: empty cells, single seeds, parity, timing, curves."""

import pytest
from pyspark.sql import functions as F

from graftwork.functions import columns as C
from graftwork.operators import reports as R
from graftwork.operators import timing as T

CFG = R.ReportConfig()
COLS = "experiment string, seed string, name string, task string, lr double, checkpoint string, step bigint, accuracy double, row_id bigint"


def metrics(spark, rows, experiment="e"):
    return spark.createDataFrame([(experiment, *r, i) for i, r in enumerate(rows)], COLS)


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_empty_cells_are_zero_and_pull_the_average(spark):
    m = metrics(spark, [("s0", "base", "a", None, None, None, 0.5), ("s1", "base", "a", None, None, None, 0.7),
                        ("s0", "merged", "b", None, None, None, 0.4)])
    t = table(R.mean_std(m, CFG), "role", "task")
    assert t[("base", "a")].mean == pytest.approx(60) and t[("base", "a")].std == pytest.approx(10)
    assert (t[("base", "b")].mean, t[("base", "b")].std) == (0, 0)
    assert t[("base", "Avg.")].mean == pytest.approx(30) and t[("base", "Avg.")].std == 0
    assert t[("from_scratch", "Avg.")].mean == 0 and len(t) == 4 * 3


def test_average_deviation_is_over_seed_averages(spark):
    rows = [(s, "base", k, None, None, None, v) for s, k, v in
            [("s0", "a", 0.2), ("s0", "b", 0.4), ("s1", "a", 0.6), ("s1", "b", 0.4)]]
    t = table(R.mean_std(metrics(spark, rows), CFG), "role", "task")
    assert t[("base", "Avg.")].std == pytest.approx(10) and t[("base", "b")].std == pytest.approx(0)


def test_first_row_counts_and_checkpoint_is_respected(spark):
    m = metrics(spark, [("s0", "base", "a", None, None, None, 0.1), ("s0", "base", "a", None, None, None, 0.9),
                        ("s0", "trained_scratch", "a", None, "checkpoint-1", 1, 0.3), ("s0", "trained_scratch", "a", None, "final", None, 0.8)])
    t = table(R.mean_std(m.repartition(5), CFG), "role", "task")
    assert t[("base", "a")].mean == pytest.approx(10) and t[("from_scratch", "a")].mean == pytest.approx(80)


def test_best_flags_first_method_wins_ties(spark):
    df = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 5.0), ("b", 0, 1.0), ("b", 1, 2.0), ("c", 0, -1.0)], "task string, o int, mean double")
    t = table(R.flag_best(df, ["task"], "o"), "task", "o")
    assert {k for k, r in t.items() if r.is_best} == {("a", 0), ("b", 1)}


def curve(spark, base, merged, points, extra=()):
    rows = [("s", "trained_scratch", "a", None, "final", None, base), ("s", "merged", "a", None, None, None, merged)]
    rows += [("s", "trained_merged", "a", None, c, s, v) for c, s, v in points]
    return metrics(spark, [*rows, *extra])


@pytest.mark.parametrize(
    "base, merged, points, want",
    [
        (0.5, 0.5, [("checkpoint-10", 10, 0.6)], 0.0),
        (0.5, 0.4, [], 100.0),
        (0.5, 0.4, [("final", None, 0.9)], 100.0),
        (0.5, 0.4, [("checkpoint-10", 10, 0.45), ("checkpoint-20", 20, 0.48)], 100.0),
        (0.5, 0.4, [("checkpoint-10", 10, 0.6), ("checkpoint-20", 20, 0.2)], 25.0),
        (0.5, 0.4, [("checkpoint-10", 10, 0.45), ("checkpoint-20", 20, 0.55)], 75.0),
        (0.5, 0.4, [("checkpoint-20", 20, 0.55), ("checkpoint-10", 10, 0.45), (None, None, 0.9)], 75.0),
        (0.5, 0.4, [(None, 10, 0.6), ("checkpoint-20", 20, 0.2)], 25.0),
    ],
)
def test_parity(spark, base, merged, points, want):
    assert R.training_to_parity(curve(spark, base, merged, points), CFG).first().parity == pytest.approx(want)


def test_incomplete_seed_is_dropped_whole(spark):
    full = [(s, n, k, None, c, None, v) for s in ("s0", "s1") for k in ("a", "b")
            for n, c, v in (("trained_scratch", "final", 0.5), ("merged", None, 0.6))]
    parity = R.training_to_parity(metrics(spark, full[:-1]), CFG)
    assert {r.seed for r in R.complete_seeds(parity).collect()} == {"s0"}


def speed(spark, values):
    rows = [("e", s, k, 0.5, 0.4, float(v)) for s, k, v in values]
    return spark.createDataFrame(rows, "experiment string, seed string, task string, baseline double, merged double, parity double")


def test_speedups_normal_and_strict(spark):
    p = speed(spark, [("s0", "a", 50), ("s0", "b", 100), ("s1", "a", 30), ("s1", "b", 20)])
    t = table(R.speedup_agg(p), "task")
    assert t[("a",)].mean == 40 and t[("b",)].mean == 60 and t[("Avg.",)].mean == 50 and t[("Avg.",)].std == 25
    s = table(R.speedup_agg(p, strict=True), "task")
    assert s[("b",)].mean is None and s[("b",)].std == 0 and s[("Avg.",)].mean == 40 and s[("Avg.",)].std == 10


def test_all_zero_speedup_has_no_average(spark):
    t = table(R.speedup_agg(speed(spark, [("s0", "a", 0), ("s1", "a", 0)])), "task")
    assert t[("a",)].mean == 0 and t[("Avg.",)].mean is None


def test_isclose_tolerance(spark):
    rates = spark.createDataFrame([(5e-5,), (1.6e-4,), (1.0,)], "lr double")
    lrs = [5e-5, 5e-5 * (1 + 9e-6), 5e-5 + 1.2e-8, 1.6e-4 - 1.1e-8, 1 + 0.9e-5, 1 + 1.2e-5, 5e-5 - 1.04e-8]
    df = spark.createDataFrame([(v,) for v in lrs], "lr double")
    hits = {r.lr for r in R.isclose_join(df, rates).collect()}
    want = {v for v in lrs for r in (5e-5, 1.6e-4, 1.0) if abs(v - r) <= 1e-8 + 1e-5 * abs(r)}
    assert hits == want and 0 < len(want) < len(lrs)


def test_lr_curves_without_rows_are_null(spark):
    m = metrics(spark, [("s0", "sweep_scratch", "a", 1e-4, "final", None, 0.5), ("s0", "sweep_merged", "a", 2e-4, "final", None, 0.5)])
    t = table(R.lr_task_curve(m, CFG), "method", "lr")
    assert t[("from_scratch", 1e-4)].mean == 50 and t[("from_merged", 1e-4)].mean is None
    assert t[("from_merged", 1e-4)].std == 0 and len(t) == 2


def test_nearest_sweep_first_on_ties_and_curve_start(spark):
    rows = [("s0", "base", "a", None, None, None, 0.1), ("s0", "trained_scratch", "a", None, "final", None, 0.5),
            ("s0", "sweep_scratch", "a", 1e-4, "checkpoint-10", 10, 0.3), ("s0", "sweep_scratch", "a", 1e-4, "final", None, 0.4),
            ("s0", "sweep_scratch", "a", 2e-4, "checkpoint-10", 10, 0.2), ("s0", "sweep_scratch", "a", 2e-4, "final", None, 0.6)]
    m = metrics(spark, rows)
    assert [r.lr for r in R.best_sweep(m, CFG).collect()] == [1e-4]
    pts = sorted((r.ordinal, r.step, round(r.mean, 6)) for r in R.training_curves(m, CFG).collect())
    assert pts == [(0, 0, 10.0), (1, 10, 30.0)]


TIMES = "experiment string, seed string, stage string, job string, job_type string, elapsed_s double, cached boolean, row_id bigint"


def test_timing_by_hand(spark):
    m = metrics(spark, [("s0", "trained_scratch", "a", None, "final", None, 0.5), ("s0", "merged", "a", None, None, None, 0.4),
                        ("s0", "trained_merged", "a", None, "checkpoint-10", 10, 0.5), ("s0", "trained_merged", "a", None, "checkpoint-20", 20, 0.5),
                        ("s0", "sweep_scratch", "a", 5e-5, "final", None, 0.3), ("s0", "sweep_scratch", "a", 1e-4, "final", None, 0.3),
                        ("s0", "sweep_merged", "a", 1e-4, "final", None, 0.3),
                        ("s0", "base", "b", None, None, None, 0.1), ("s1", "base", "a", None, None, None, 0.1)])
    jobs = [("s0", "train", "train_a_5.0E-5", "train", 100.0, False), ("s0", "train", "train_a_0.0001", "train", 70.0, False),
            ("s0", "relevance", "relevance_b_a", "eval", 7.0, False), ("s0", "relevance", "relevance_a_a", "eval", 5.0, False),
            ("s0", "relevance", "relevance_a_ba", "eval", 1.0, False), ("s0", "merge", "merge_a", "merge", 2.0, False),
            ("s0", "train_merged", "train_merged_a_1e-04", "train", 40.0, False), ("s0", "other", "other", "x", 9.0, True),
            ("s1", "merge", "merge_a", "merge", 2.0, True)]
    t = T.parse_jobs(spark.createDataFrame([("e", *r, i) for i, r in enumerate(jobs)], TIMES))
    facts = table(T.timing_facts(m, t, CFG), "seed", "task")
    a = facts[("s0", "a")]
    # Ties on accuracy pick the first rate; parity at step 10 of 20.
    assert (a.scratch_s, a.relevance_s, a.merge_s, a.retrain_s, a.parity) == (100, 5, 2, 40, 50)
    assert a.reuse_s == 27 and a.ratio == 0.27
    assert facts[("s0", "b")].scratch_s is None and facts[("s0", "b")].parity == 100
    assert set(facts) == {("s0", "a"), ("s0", "b")}
    agg = table(T.timing_agg(T.timing_facts(m, t, CFG)), "task")
    assert agg[("Avg.",)].ratio == 0.27 and agg[("b",)].ratio is None


def test_null_checkpoint_is_intermediate(spark):
    df = spark.createDataFrame([("final",), (None,), ("checkpoint-1",)], "checkpoint string")
    assert df.filter(C.is_intermediate("checkpoint")).count() == 2


def test_labels(spark):
    names = {"arc_easy": "ARC-e", "mnli": "Mnli", "very_long_task": "Very Lon.", "mine": "M!"}
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert {r.t: r.x for r in df.select("t", C.task_label("t", {"mine": "M!"}).alias("x")).collect()} == names
    rates = {5e-5: "5e-5", 1.6e-4: "1.6e-4", 2.75e-4: "2.75e-4", 1.0: "1e0", 10.0: "1e1"}
    df = spark.createDataFrame([(v,) for v in rates], "v double")
    assert {r.v: r.x for r in df.select("v", C.lr_label("v").alias("x")).collect()} == rates


def test_cells(spark):
    df = spark.createDataFrame([(71.23, 0.5, 3), (71.23, 0.5, 1), (0.0, 0.0, 3), (None, None, 0)], "m double, s double, n int")
    out = df.select(C.fmt_val("m", "s", "n").alias("v"), C.fmt_speedup("m", "s", "n").alias("p"), C.fmt_time("m").alias("t"), C.fmt_pct("m").alias("q")).collect()
    assert [r.v for r in out[:3]] == ["71.2 ± 0.5", "71.2", "0.0"]
    assert [r.p for r in out] == ["71.2 ± 0.5", "71.2", "0", "---"]
    assert [r.t for r in out] == ["71", "71", "0", "---"] and [r.q for r in out] == ["7123%", "7123%", "0%", "---"]
    spans = {5.0: "5.0s", 65.0: "1m 05s", 3_725.9: "1h 02m 05s"}
    got = spark.createDataFrame([(v,) for v in spans], "v double").select("v", C.duration_label("v").alias("x")).collect()
    assert {r.v: r.x for r in got} == spans


def test_combined_uses_the_first_experiments_tasks(spark):
    one = metrics(spark, [("s0", "trained_scratch", "a", None, "final", None, 0.5), ("s0", "trained_merged", "a", None, "final", None, 0.5)], "e1")
    two = metrics(spark, [("s0", "trained_scratch", "a", None, "final", None, 0.6), ("s0", "trained_scratch", "z", None, "final", None, 0.9)], "e2")
    both = one.unionByName(two).withColumn("setup", R.setup_label(F.lit("fullft")))
    t = table(R.combined_results(both, CFG), "experiment", "setup", "task")
    assert {k[2] for k in t} == {"a", "Avg."} and {k[1] for k in t} == {"Full FT"}
    assert not t[("e1", "Full FT", "a")].scratch_wins and not t[("e1", "Full FT", "a")].merged_wins
    assert t[("e2", "Full FT", "a")].scratch_wins and t[("e2", "Full FT", "a")].merged_mean == 0


def test_listed_refuses_an_unbounded_header(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_LISTED", 2)
    with pytest.raises(ValueError):
        R.listed(spark.range(5), "id")
