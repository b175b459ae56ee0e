"""Wall-clock reports over the job timing table.

``timing(seed, stage, job, task, lr, elapsed_s, cached, row_id)``; task and lr
come from :func:`parse_jobs`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork.operators.reports import AVG, BY, ReportConfig, best_lr, first_experiment_tasks, only_shown, training_to_parity
from graftwork.operators.scale import join_on

MEASURES = ("scratch_s", "reuse_s", "ratio")


def parse_jobs(timing: DataFrame) -> DataFrame:
    """Split ``<stage>_<task>[_<lr>]`` job names; the rate becomes a number.

    Comparing numbers instead of text makes ``5e-05`` and ``5.0E-5`` equal.
    """
    rest = F.substr(F.col("job"), F.length("stage") + F.lit(2))
    rate = F.regexp_extract(rest, r"_(\d[\d.eE+\-]*)$", 1)
    is_train = F.col("job_type") == "train"
    if "subjob" in timing.columns:
        # A training job counts by its own part, not by an evaluation run under it.
        is_train = is_train & F.coalesce(F.col("subjob") == F.concat("job", F.lit("_train")), F.lit(False))
    return timing.withColumns(
        {
            "task": F.when(is_train, F.regexp_replace(rest, r"_\d[\d.eE+\-]*$", "")).otherwise(rest),
            "lr": F.when(is_train & (rate != ""), rate).cast("double"),
        }
    )


def stage_totals(timing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return timing.groupBy(*by, "stage").agg(F.sum("elapsed_s").alias("total_s"))


def uncached_seeds(timing: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Seeds without any cached row in a stage the report needs."""
    needed = F.col("stage").isin(list(cfg.timing_stages.values()))
    seeds = timing.groupBy(*by, "seed").agg(F.bool_or(needed & F.coalesce("cached", F.lit(False))).alias("hit"))
    return seeds.filter(~F.col("hit")).select(*by, "seed")


def _name_suffixes(job: str = "job") -> Column:
    """Every part of a job name that follows an underscore."""
    parts = F.split(job, "_")
    tails = lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_")
    return F.when(F.col(job).contains("_"), F.transform(F.sequence(F.lit(2), F.size(parts)), tails))


def relevance_time(timing: DataFrame, task_names: DataFrame, stage: str, by: Sequence[str] = BY) -> DataFrame:
    """Fastest job of the stage whose name ends in ``_<task>``.

    Each job is keyed by every suffix of its name that follows an underscore,
    which turns the ends-with test into an equi-join.
    """
    keyed = (
        timing.filter(F.col("stage") == stage)
        .select(*by, "seed", F.explode(_name_suffixes()).alias("task"), "elapsed_s")
        .groupBy(*by, "seed", "task")
        .agg(F.min("elapsed_s").alias("relevance_s"))
    )
    return join_on(keyed, task_names, [*by, "task"], "left_semi")


def _job_seconds(timing: DataFrame, cfg: ReportConfig, by: Sequence[str]) -> DataFrame:
    """Seconds per (seed, task, kind, lr) of all four stages in one pass.

    Training and merge jobs count by their first row, relevance jobs by the
    fastest one, under every task their name may end in.
    """
    st = cfg.timing_stages
    stage = F.col("stage")
    entry = lambda kind, tasks, lr: F.transform(
        tasks, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("task"), lr.alias("lr"))
    )
    own, no_lr = F.array("task"), F.lit(None).cast("double")
    trained = F.col("lr").isNotNull()
    entries = (
        F.when((stage == st["train"]) & trained, entry("from_scratch", own, F.col("lr")))
        .when((stage == st["train_merged"]) & trained, entry("from_merged", own, F.col("lr")))
        .when(stage == st["relevance"], entry("relevance", _name_suffixes(), no_lr))
        .when(
            (stage == st["merge"]) & (F.col("job") == F.concat(F.lit(st["merge"] + "_"), F.col("task"))),
            entry("merge", own, no_lr),
        )
    )
    rows = timing.filter(stage.isin(list(st.values()))).withColumn("__e", F.explode(entries))
    fastest, first = F.min("elapsed_s"), F.min_by("elapsed_s", "row_id")
    return rows.groupBy(*by, "seed", "__e.task", "__e.kind", "__e.lr").agg(
        F.when(F.col("kind") == "relevance", fastest).otherwise(first).alias("secs")
    )


def timing_facts(
    metrics: DataFrame, timing: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY
) -> DataFrame:
    """Train, relevance, merge and retrain seconds and parity per (seed, task).

    Seeds need both tables and no cached stage. A missing time stays null and
    makes the sums null; a missing parity counts as the full training.
    """
    keys = [*by, "seed", "task"]
    best = best_lr(metrics, cfg, by).select(*keys, F.col("role").alias("kind"), F.col("lr").alias("__lr"))
    secs = join_on(_job_seconds(timing, cfg, by), best, [*keys, "kind"], "left")
    secs = secs.filter(F.col("lr").isNull() | (F.col("lr") == F.col("__lr")))
    pick = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col("secs"))).alias(name)
    wide = secs.groupBy(*keys).agg(
        pick("from_scratch", "scratch_s"),
        pick("relevance", "relevance_s"),
        pick("merge", "merge_s"),
        pick("from_merged", "retrain_s"),
    )
    parity = training_to_parity(metrics, cfg, by).select(*keys, F.coalesce("parity", F.lit(100.0)).alias("parity"))
    parity = join_on(parity, uncached_seeds(timing, cfg, by), [*by, "seed"], "left_semi")
    out = join_on(parity, wide, keys, "left")
    reuse = F.col("relevance_s") + F.col("merge_s") + F.col("retrain_s") * F.col("parity") / 100
    out = out.withColumn("reuse_s", F.when(F.col("scratch_s").isNotNull(), reuse))
    return out.withColumn("ratio", F.when(F.col("scratch_s") > 0, F.col("reuse_s") / F.col("scratch_s")))


def timing_agg(facts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean seconds and ratio per task over seeds, and the mean of seed means; one pass over the facts."""
    means = [F.avg(m).alias(m) for m in MEASURES]
    sets = facts.groupingSets([[*by, "task"], [*by, "seed"]], *by, "task", "seed").agg(F.grouping("task").alias("__avg"), *means)
    task = F.when(F.col("__avg") == 1, F.lit(AVG)).otherwise(F.col("task"))
    # A task has one row here, whose mean is itself; the seeds of a report have one each.
    table = sets.withColumn("task", task).groupBy(*by, "__avg", "task").agg(*means)
    return table.select(*by, "task", *MEASURES)


def combined_timing(
    metrics: DataFrame, timing: DataFrame, cfg: ReportConfig, by: Sequence[str] = ("experiment", "setup")
) -> DataFrame:
    """Timing table of every experiment at once, averaged over its own tasks.

    The first experiment's tasks only choose which columns are shown.
    """
    return only_shown(timing_agg(timing_facts(metrics, timing, cfg, by), by), first_experiment_tasks(metrics))
