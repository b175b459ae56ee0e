"""Whole flows: select and merge for all targets, analyse the runs of models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.operators import merging, ranking
from graftwork.operators import reports as R
from graftwork.operators import timing as T
from graftwork.sources import evaluations, runs

FIXED_ROLES = ("base", "from_scratch", "merged")


def report_config(pipeline: Mapping, from_merged: str | None = None) -> R.ReportConfig:
    """Report roles from a parsed pipeline file (``stages.analysis.config``).

    ``from_merged`` names the method trained from the merged start. Without it
    that is the only one besides base, from_scratch and merged, if there is one.
    All other methods keep their own names as roles.
    """
    analysis = ((pipeline.get("stages") or {}).get("analysis") or {}).get("config") or {}
    if "group" not in analysis:
        raise ValueError("the pipeline needs a 'stages.analysis.config' section with a 'group'")
    if from_merged is None:
        others = [k for k in analysis["methods"] if k not in FIXED_ROLES]
        from_merged = "from_merged" if "from_merged" in others else others[0] if len(others) == 1 else None
    role = lambda key: "from_merged" if key == from_merged else key
    methods = tuple(
        R.Method(role(k), m["name"], m["display"], m.get("checkpoint")) for k, m in analysis["methods"].items()
    )
    return R.ReportConfig(
        methods,
        {role(k): v for k, v in (analysis.get("sweeps") or {}).items()},
        dict(analysis.get("timing_stages") or {}),
        analysis.get("task_labels") or None,
    )


def select_and_merge(
    docs: DataFrame,
    params: DataFrame,
    k: int = 2,
    metric: str = "accuracy",
    weight_strategy: str = "equal",
    target: str = "target_task",
    method: str = merging.AVERAGE,
    base: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Top-k recipe and merged parameters of every target, in one job each."""
    best = ranking.select_topk(docs, k, metric, weight_strategy, [target])
    recipe = ranking.as_recipe(best, target)
    return best, merging.merge(method, params, recipe, base)


def report_tables(
    metrics: DataFrame, timing: DataFrame | None, cfg: R.ReportConfig, by: Sequence[str] = R.BY
) -> dict[str, DataFrame]:
    """Every table of an analysis; ``by`` keeps experiments apart in one pass."""
    results = R.mean_std(metrics, cfg, by)
    parity = R.training_to_parity(metrics, cfg, by)
    tables = {
        "results": R.flag_best(results, [*by, "task"], "method_ord"),
        "speedup": R.speedup_agg(parity, by),
        "speedup_strict": R.speedup_agg(parity, by, strict=True),
    }
    if cfg.sweeps:
        sweep = R.lr_sweep(metrics, cfg, by)
        tables |= {
            "lr_sensitivity": R.lr_sensitivity(metrics, cfg, by).drop("row_id"),
            "lr_sweep": R.flag_best(sweep, [*by, "method", "task"], "lr"),
            "lr_curve": R.lr_curve(metrics, cfg, by),
            "lr_task_curve": R.lr_task_curve(metrics, cfg, by),
            "training_curves": R.training_curves(metrics, cfg, by),
            "converged": R.converged(metrics, cfg, by),
        }
    if timing is not None and cfg.sweeps and cfg.timing_stages:
        tables["timing"] = T.timing_agg(T.timing_facts(metrics, T.parse_jobs(timing), cfg, by), by)
    return tables


def _timing_or_none(spark: SparkSession, run_dirs: Sequence[str]) -> DataFrame | None:
    try:
        return runs.read_timing(spark, run_dirs)
    except ValueError:
        return None


def analyze_model(
    spark: SparkSession, run_dirs: Sequence[str], cfg: R.ReportConfig, experiment: str = "unknown"
) -> dict[str, DataFrame]:
    """All tables of one model over its seeds; a single run is a list of one."""
    if not run_dirs:
        raise ValueError("no run directories given")
    metrics = runs.read_seeds(spark, run_dirs).withColumn("experiment", F.lit(experiment))
    timing = _timing_or_none(spark, run_dirs)
    if timing is not None:
        timing = timing.withColumn("experiment", F.lit(experiment))
    return report_tables(metrics, timing, cfg)


def analyze_combined(
    metrics: DataFrame, timing: DataFrame | None, cfg: R.ReportConfig, by: Sequence[str] = ("experiment", "setup")
) -> dict[str, DataFrame]:
    """Cross-model tables; ``metrics`` and ``timing`` carry experiment and setup."""
    tables = {"combined_results": R.combined_results(metrics, cfg, by), "combined_speedup": R.combined_speedup(metrics, cfg, by)}
    if timing is not None and cfg.timing_stages:
        tables["combined_timing"] = T.combined_timing(metrics, T.parse_jobs(timing), cfg, by)
    return tables


def write_tables(tables: Mapping[str, DataFrame], out_dir: str) -> None:
    """One CSV folder per table."""
    for name, table in tables.items():
        evaluations.write_csv(table, f"{out_dir}/{name}.csv")
