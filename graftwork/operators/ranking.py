"""Rank evaluated checkpoints per target, select the top k, weigh them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftwork.functions.columns import basename, glob_filter, is_self_eval
from graftwork.functions.fixed import LOWER_IS_BETTER
from graftwork.operators.scale import first_rows, join_on, positions


def candidates(
    docs: DataFrame, metric: str, include: str | None = None, exclude: str | None = None, name: str = "eval_dir"
) -> DataFrame:
    """Result rows whose directory matches and that carry the metric."""
    out = docs.filter(F.col(metric).isNotNull())
    return out.filter(glob_filter(basename(name), include, exclude)) if include else out


def self_eval(docs: DataFrame) -> DataFrame:
    """Rows where a checkpoint was scored on its own dataset."""
    return docs.filter(is_self_eval("dataset", "model"))


def leave_one_out(docs: DataFrame, source: str = "source_task", target: str = "target_task") -> DataFrame:
    """Drop a target's own checkpoint from its candidates."""
    return docs.filter(F.col(source) != F.col(target))


def relevance_grid(checkpoints: DataFrame, targets: Sequence[str], task: str = "task") -> DataFrame:
    """Evaluations to plan: each checkpoint on every listed target but its own."""
    others = F.explode(F.array(*[F.lit(t) for t in targets]))
    return checkpoints.withColumn("target_task", others).filter(F.col(task) != F.col("target_task"))


def best_first(metric: str) -> Column:
    return F.col(metric).asc() if metric in LOWER_IS_BETTER else F.col(metric).desc()


def rank_models(
    docs: DataFrame, metric: str = "accuracy", group: Sequence[str] = ("target_task",), tie: str = "eval_dir"
) -> DataFrame:
    """Full ranking per target; equal scores keep directory-name order."""
    return (
        positions(_named_groups(candidates(docs, metric), group), group, [best_first(metric), F.col(tie)], "__pos")
        .withColumn("rank", F.col("__pos") + 1)
        .drop("__pos")
    )


def merge_weights(
    selected: DataFrame, metric: str, strategy: str = "equal", group: Sequence[str] = ("target_task",)
) -> DataFrame:
    """Add ``weight``: 1, or in proportion to the score (inverted if lower is better)."""
    if strategy != "proportional":
        return selected.withColumn("weight", F.lit(1.0))
    score = F.col(metric).cast("double")
    if metric in LOWER_IS_BETTER:
        tops = selected.groupBy(*group).agg(F.max(score).alias("__top"))
        score = F.when(score > 0, F.col("__top") / score).otherwise(0.0)
        return join_on(selected, tops, group).withColumn("weight", F.round(score, 6)).drop("__top")
    return selected.withColumn("weight", F.round(score, 6))


def _named_groups(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """A missing dataset name counts as the empty name, not as unknown."""
    texts = [f.name for f in rows.schema if f.name in group and f.dataType == T.StringType()]
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def select_topk(
    docs: DataFrame,
    k: int,
    metric: str = "accuracy",
    weight_strategy: str = "equal",
    group: Sequence[str] = ("target_task",),
    tie: str = "eval_dir",
) -> DataFrame:
    """The best ``k`` rows of each target with rank, weight and candidate count.

    Rows are cut by :func:`first_rows` and candidates counted with partial
    sums, so a hot target never meets in one task as a whole.
    """
    rows = _named_groups(candidates(docs, metric), group)
    best = first_rows(rows, k, group, [best_first(metric), F.col(tie)])
    best = merge_weights(best, metric, weight_strategy, group)
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("num_candidates"))
    return join_on(best, counts, group)


def select_best(
    docs: DataFrame,
    metric: str = "accuracy",
    group: Sequence[str] = ("target_task",),
    tie: str = "eval_dir",
    link_name: Column | None = None,
) -> DataFrame:
    """The single best row of each group, under its canonical name."""
    best = select_topk(docs, 1, metric, group=group, tie=tie).drop("weight", "rank")
    return best.withColumn("link_name", link_name) if link_name is not None else best


def as_recipe(selected: DataFrame, target: str = "target_task", model: Column | str = "model") -> DataFrame:
    """Selected rows as a merge recipe ``(target, model, ord, weight)``."""
    m = F.col(model) if isinstance(model, str) else model
    return selected.select(
        F.col(target).alias("target"), m.alias("model"), (F.col("rank") - 1).alias("ord"), "weight"
    )
