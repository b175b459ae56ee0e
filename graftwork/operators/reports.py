"""Reports over the ``metrics`` table: accuracy, learning rates, parity, curves.

``metrics(experiment, seed, name, task, lr, checkpoint, step, accuracy, row_id)``
has one row per evaluated checkpoint; ``row_id`` is the stored order and decides
wherever "the first row" is meant. Reports never loop over experiments, seeds
or tasks: those are grouping keys (``by`` names the leading ones).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftwork.functions.columns import is_intermediate, is_not, pct
from graftwork.functions.fixed import FINAL_CHECKPOINT, SETUP_LABELS
from graftwork.operators.scale import join_on, pin_small, positions, settle

AVG = "Avg."
BY = ("experiment",)
MAX_LISTED = 10_000


@dataclass(frozen=True)
class Method:
    role: str
    name: str
    display: str
    checkpoint: str | None = None


@dataclass(frozen=True)
class ReportConfig:
    """Which summary names play which role."""

    methods: tuple[Method, ...] = (
        Method("base", "base", "Base model"),
        Method("from_scratch", "trained_scratch", "From scratch", FINAL_CHECKPOINT),
        Method("merged", "merged", "Merged (zero-shot)"),
        Method("from_merged", "trained_merged", "From merged", FINAL_CHECKPOINT),
    )
    sweeps: dict[str, str] = field(
        default_factory=lambda: {"from_scratch": "sweep_scratch", "from_merged": "sweep_merged"}
    )
    timing_stages: dict[str, str] = field(
        default_factory=lambda: {s: s for s in ("train", "relevance", "merge", "train_merged")}
    )
    task_labels: dict[str, str] | None = None

    def name_of(self, role: str) -> str:
        return next(m.name for m in self.methods if m.role == role)


# --- dimensions -----------------------------------------------------------------
def tasks(df: DataFrame) -> DataFrame:
    return df.select("task").distinct().orderBy("task")


def lrs(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = ()) -> DataFrame:
    """Learning rates of the first sweep's final rows."""
    first = next(iter(cfg.sweeps.values()))
    final = df.filter((F.col("name") == first) & (F.col("checkpoint") == FINAL_CHECKPOINT))
    return final.filter(F.col("lr").isNotNull()).select(*by, "lr").distinct().orderBy(*by, "lr")


def listed(df: DataFrame, column: str) -> list:
    """Sorted distinct values for a pivot header; refuses an unbounded header."""
    rows = df.select(column).distinct().orderBy(column).limit(MAX_LISTED + 1).collect()
    if len(rows) > MAX_LISTED:
        raise ValueError(f"more than {MAX_LISTED} distinct values of {column}")
    return [r[0] for r in rows]


def _literals(values: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def tag_methods(df: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Rows playing a role, with ``role``, ``display`` and ``method_ord``.

    The role list is literal, so this is a filter with a generator: no join.
    """
    row = lambda i, m: F.struct(
        F.lit(m.role).alias("role"), F.lit(m.display).alias("display"), F.lit(i).alias("method_ord")
    )
    hits = []
    for i, m in enumerate(cfg.methods):
        hit = F.col("name") == m.name
        if m.checkpoint is not None:
            hit = hit & (F.col("checkpoint") == m.checkpoint)
        hits.append(F.when(hit, row(i, m)))
    wanted = F.col("name").isin([m.name for m in cfg.methods])
    tagged = df.filter(wanted).withColumn("__m", F.explode(F.array_compact(F.array(*hits))))
    return tagged.select("*", "__m.*").drop("__m")


def tag_sweeps(df: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Sweep rows with the role of their sweep."""
    role = F.coalesce(*[F.when(F.col("name") == name, F.lit(role)) for role, name in cfg.sweeps.items()])
    return df.filter(F.col("name").isin(list(cfg.sweeps.values()))).withColumn("role", role)


def first_by_row(value: str, order: str = "row_id") -> Column:
    return F.min_by(value, order)


def _all_tasks(df: DataFrame, by: Sequence[str], shown: DataFrame | None) -> DataFrame:
    """The task columns of each report, so that missing cells exist.

    ``shown`` gives every report the same columns: it becomes one row with an
    array, which every report unfolds.
    """
    if shown is None:
        return df.select(*by, "task").distinct()
    row = shown.agg(F.collect_list("task").alias("__tasks")).withColumn("__one", F.lit(1))
    reports = df.select(*by).distinct().withColumn("__one", F.lit(1))
    return reports.join(F.broadcast(row), "__one").select(*by, F.explode("__tasks").alias("task"))


def only_shown(table: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows of a table's shown tasks and its averages."""
    average = table.sparkSession.createDataFrame([(AVG,)], "task string")
    return table.join(shown.select("task").unionByName(average), "task", "left_semi").select(*table.columns)


# --- mean and deviation tables -------------------------------------------------------
def task_table(values: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation over seeds per task, plus an ``Avg.`` row.

    ``values`` has one ``value`` per (by, seed, task), ``cells`` lists the
    expected (by, task). An empty cell is 0. The average's deviation is taken
    over the seed averages of seeds that have every task. Tasks and seeds are
    grouping sets of one pass; what is left, one row per task and seed of a
    report, meets by report.
    """
    rows = values.select(*by, "seed", "task", "value", F.lit(0).alias("__cell")).unionByName(
        cells.select(*by, "task", F.lit(1).alias("__cell")), allowMissingColumns=True
    )
    sets = rows.groupingSets([[*by, "task"], [*by, "seed"]], *by, "task", "seed").agg(
        F.grouping("seed").alias("__is_task"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count_if(F.col("__cell") == 0).alias("n_seeds"),
        F.max("__cell").alias("__cell"),
    )
    is_task = F.col("__is_task") == 1
    report = Window.partitionBy(*by)
    sets = sets.withColumn("__tasks", F.count_if(is_task & (F.col("__cell") == 1)).over(report))
    sets = sets.filter(F.when(is_task, F.col("__cell") == 1).otherwise((F.col("n_seeds") > 0) & (F.col("n_seeds") == F.col("__tasks"))))
    # A task's row stands for itself and counts in the average; a seed's row only does the latter.
    own = F.when(is_task, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    sets = sets.withColumn("__avg", F.explode(own))
    task = F.when(F.col("__avg"), F.lit(AVG)).otherwise(F.col("task"))
    seed_mean = F.when(~is_task, F.col("mean"))
    table = sets.withColumn("task", task).groupBy(*by, "__avg", "task").agg(
        F.avg(F.when(is_task, F.coalesce("mean", F.lit(0.0)))).alias("mean"),
        F.when(F.col("__avg"), F.stddev_pop(seed_mean)).otherwise(F.max("std")).alias("std"),
        F.when(F.col("__avg"), F.count_if(~is_task)).otherwise(F.max("n_seeds")).alias("n_seeds"),
    )
    return table.fillna(0, subset=["mean", "std", "n_seeds"]).select(*cells.columns, "mean", "std", "n_seeds")


def method_values(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Accuracy in percent per role, seed and task: the first matching row."""
    return (
        tag_methods(df, cfg)
        .groupBy(*by, "role", "display", "method_ord", "seed", "task")
        .agg(first_by_row("accuracy").alias("accuracy"))
        .withColumn("value", pct("accuracy"))
    )


def mean_std(
    df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY, shown: DataFrame | None = None
) -> DataFrame:
    """Results table in long form: every role x task cell and the averages."""
    roles = F.explode(
        F.array(
            *[
                F.struct(F.lit(m.role).alias("role"), F.lit(m.display).alias("display"), F.lit(i).alias("method_ord"))
                for i, m in enumerate(cfg.methods)
            ]
        )
    )
    cells = _all_tasks(df, by, shown).withColumn("__m", roles).select(*by, "task", "__m.*")
    values = method_values(df, cfg, by)
    if shown is not None:
        values = values.join(shown, "task", "left_semi")
    return task_table(values, cells, [*by, "role", "display", "method_ord"])


def flag_best(table: DataFrame, within: Sequence[str], order: str, value: str = "mean") -> DataFrame:
    """Mark the largest value per column; the first in order wins ties.

    ``order`` runs over the literal role list or the learning rates, so a
    window group holds one report column.
    """
    w = Window.partitionBy(*within).orderBy(F.col(value).desc(), F.col(order))
    return table.withColumn("is_best", (F.row_number().over(w) == 1) & (F.col(value) > -1))


def pivot_results(
    table: DataFrame, rows: Sequence[str], task_names: Sequence[str], value: str = "mean"
) -> DataFrame:
    """Rows x tasks matrix; naming the columns saves the extra distinct job."""
    return table.groupBy(*rows).pivot("task", [*task_names, AVG]).agg(F.first(value))


# --- learning rates ----------------------------------------------------------------------
def lr_sensitivity(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Final sweep rows with a learning rate, as (method, dataset, lr, accuracy, seed)."""
    final = tag_sweeps(df, cfg).filter((F.col("checkpoint") == FINAL_CHECKPOINT) & F.col("lr").isNotNull())
    return final.select(
        *by, F.col("role").alias("method"), F.col("task").alias("dataset"), "lr", "accuracy", "seed", "row_id"
    )


def lr_sweep(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Mean and deviation per (method, lr, task) with averages; exact lr match."""
    values = (
        lr_sensitivity(df, cfg, by)
        .withColumnRenamed("dataset", "task")
        .groupBy(*by, "method", "lr", "seed", "task")
        .agg(first_by_row("accuracy").alias("accuracy"))
        .withColumn("value", pct("accuracy"))
    )
    rates = lrs(df, cfg, by)
    cells = join_on(_all_tasks(df, by, None), rates, by).withColumn("method", _literals(list(cfg.sweeps)))
    keys = [*by, "method", "lr"]
    known = join_on(values, rates, [*by, "lr"], "left_semi")
    return task_table(known, cells, keys)


def isclose_join(df: DataFrame, rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach the listed ``rate`` that a row's ``lr`` is close to.

    ``|lr - rate| <= 1e-8 + 1e-5 * |rate|``. On the scale
    ``1e5 * ln(1 + 1000 |x|)`` that tolerance is about one unit everywhere, so
    candidates share a bucket or sit next to it and the match is an equi-join.
    """
    scaled = lambda c: F.signum(c) * 1e5 * F.log1p(F.abs(c) * 1000.0)
    near = rates.select(*by, F.col("lr").alias("rate"))
    near = near.withColumn("__slot", F.floor(scaled(F.col("rate")) / 2))
    near = near.withColumn("__slot", F.explode(F.array(*[F.col("__slot") + d for d in (-1, 0, 1)])))
    rows = df.withColumn("__slot", F.floor(scaled(F.col("lr")) / 2))
    close = F.abs(F.col("lr") - F.col("rate")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("rate")
    return join_on(rows, pin_small(near), [*by, "__slot"]).filter(close).drop("__slot")


def lr_curve(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Mean over seeds of the per-seed mean accuracy at each learning rate."""
    rows = isclose_join(lr_sensitivity(df, cfg, by), lrs(df, cfg, by), by)
    per_seed = rows.groupBy(*by, "method", "rate", "seed").agg(F.avg(pct("accuracy")).alias("v"))
    return per_seed.groupBy(*by, "method", F.col("rate").alias("lr")).agg(F.avg("v").alias("mean"))


def lr_task_curve(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Mean and deviation of all rows of a task at each rate; no rows: null and 0."""
    rates = lrs(df, cfg, by)
    rows = isclose_join(lr_sensitivity(df, cfg, by), rates, by)
    stats = rows.groupBy(*by, "method", F.col("dataset").alias("task"), F.col("rate").alias("lr")).agg(
        F.avg(pct("accuracy")).alias("mean"), F.stddev_pop(pct("accuracy")).alias("std")
    )
    cells = join_on(_all_tasks(df, by, None), rates, by).withColumn("method", _literals(list(cfg.sweeps)))
    return join_on(cells, stats, [*by, "method", "task", "lr"], "left").fillna(0.0, subset=["std"])


def best_lr(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Learning rate of the best final sweep row; the first row wins ties."""
    final = tag_sweeps(df, cfg).filter(F.col("checkpoint") == FINAL_CHECKPOINT)
    key = F.struct(F.col("accuracy"), -F.col("row_id"))
    return final.filter(F.col("accuracy").isNotNull()).groupBy(*by, "seed", "role", "task").agg(
        F.max_by("lr", key).alias("lr"), F.max("accuracy").alias("accuracy")
    )


# --- training to parity ------------------------------------------------------------------
def parity_inputs(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Baseline, merged start and last step per (seed, task), in one aggregation."""
    baseline = (F.col("name") == cfg.name_of("from_scratch")) & (F.col("checkpoint") == FINAL_CHECKPOINT)
    merged = F.col("name") == cfg.name_of("merged")
    pick = lambda cond: F.min_by("accuracy", F.when(cond, F.col("row_id")))
    return df.groupBy(*by, "seed", "task").agg(
        pick(baseline).alias("baseline"),
        pick(merged).alias("merged"),
        F.max(F.when(_on_curve(cfg), F.col("step"))).alias("last_step"),
    )


def _on_curve(cfg: ReportConfig) -> Column:
    """Intermediate checkpoints of training from the merged start; null steps are left out."""
    return (F.col("name") == cfg.name_of("from_merged")) & is_intermediate("checkpoint") & F.col("step").isNotNull()


def training_to_parity(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Share of training (in %) at which the merged start reached the baseline.

    The crossing and the point before it come from two aggregations instead of
    a window over the curve, so a curve of any length folds before it shuffles.
    ``parity`` is null where baseline or merged are missing.
    """
    keys = [*by, "seed", "task"]
    facts = parity_inputs(df, cfg, by)
    curve = df.filter(_on_curve(cfg)).select(*keys, "step", "accuracy")
    reached = (
        join_on(curve, facts, keys)
        .filter(F.col("accuracy") >= F.col("baseline"))
        .groupBy(*keys)
        .agg(F.min("step").alias("s1"), F.min_by("accuracy", "step").alias("a1"))
    )
    previous = (
        join_on(curve, reached, keys)
        .filter(F.col("step") < F.col("s1"))
        .groupBy(*keys)
        .agg(F.max("step").alias("s0"), F.max_by("accuracy", "step").alias("a0"))
    )
    points = join_on(join_on(facts, reached, keys, "left"), previous, keys, "left")
    s0 = F.coalesce(F.col("s0"), F.lit(0)).cast("double")
    a0 = F.coalesce(F.col("a0"), F.col("merged"))
    crossing = s0 + (F.col("baseline") - a0) / F.nullif(F.col("a1") - a0, F.lit(0.0)) * (F.col("s1") - s0)
    missing = F.col("baseline").isNull() | F.col("merged").isNull()
    parity = (
        F.when(missing, F.lit(None).cast("double"))
        .when(F.col("merged") >= F.col("baseline"), 0.0)
        .when(F.col("s1").isNull(), 100.0)
        .otherwise(crossing / F.nullif(F.col("last_step"), F.lit(0)) * 100)
    )
    return points.select(*keys, "baseline", "merged", parity.alias("parity"))


def complete_seeds(parity: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Rows of seeds that have baseline and merged for every task of the report."""
    n_tasks = parity.select(*by, "task").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    have = (
        parity.filter(F.col("baseline").isNotNull() & F.col("merged").isNotNull())
        .groupBy(*by, "seed")
        .agg(F.count(F.lit(1)).alias("__have"))
    )
    whole = join_on(have, n_tasks, by).filter("__have = __n").select(*by, "seed")
    return join_on(parity, whole, [*by, "seed"], "left_semi")


def speedup_agg(parity: DataFrame, by: Sequence[str] = BY, strict: bool = False) -> DataFrame:
    """Mean and deviation of parity per task and overall.

    Normal: a task never reached counts 100; an average of exactly 0 is null.
    Strict: a task is null if any seed needed 100 or more, and the average runs
    over the tasks that are left.
    """
    return _speedup(settle(parity), by, strict)


def _speedup(parity: DataFrame, by: Sequence[str], strict: bool) -> DataFrame:
    cells = _all_tasks(parity, by, None)
    values = complete_seeds(parity, by).withColumn("value", F.col("parity"))
    if not strict:
        table = task_table(values, cells, list(by))
        dashes = (F.col("task") == AVG) & (F.col("mean") == 0)
        return table.withColumn("mean", F.when(~dashes, F.col("mean")))
    values = settle(values.select(*by, "seed", "task", "value"))
    stats = values.groupBy(*by, "task").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.max("value").alias("__top"),
        F.count(F.lit(1)).alias("n_seeds"),
    )
    out = F.col("__top") >= 100
    stats = stats.withColumns(
        {"mean": F.when(~out, F.col("mean")), "std": F.when(out, 0.0).otherwise(F.col("std"))}
    )
    alive = stats.filter(~out).select(*by, "task")
    per_seed = join_on(values, alive, [*by, "task"], "left_semi").groupBy(*by, "seed").agg(F.avg("value").alias("v"))
    average = per_seed.groupBy(*by).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n_seeds")
    )
    average = join_on(cells.select(*by).distinct(), average, by, "left").withColumn("task", F.lit(AVG))
    rows = join_on(cells, stats.drop("__top"), [*by, "task"], "left")
    return rows.unionByName(average).fillna(0, subset=["std", "n_seeds"])


# --- training curves -------------------------------------------------------------------------
def best_sweep(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Checkpoints of the sweep whose final accuracy is closest to the chosen one."""
    keys = [*by, "seed", "task", "role"]
    roles = [m for m in cfg.methods if m.role in cfg.sweeps]
    role_of = F.coalesce(*[F.when(F.col("name") == m.name, F.lit(m.role)) for m in roles])
    final = df.filter(F.col("checkpoint") == FINAL_CHECKPOINT)
    chosen = (
        final.filter(F.col("name").isin([m.name for m in roles]))
        .withColumn("role", role_of)
        .groupBy(*keys)
        .agg(first_by_row("accuracy").alias("__chosen"))
    )
    sweep = tag_sweeps(df, cfg)
    finals = sweep.filter(F.col("checkpoint") == FINAL_CHECKPOINT)
    gap = F.struct(F.abs(F.col("accuracy") - F.col("__chosen")), F.col("row_id"))
    nearest = join_on(finals, chosen, keys).groupBy(*keys).agg(F.min_by("lr", gap).alias("lr"))
    steps = sweep.filter(is_not("checkpoint", FINAL_CHECKPOINT) & F.col("step").isNotNull())
    return join_on(steps, nearest, [*keys, "lr"], "left_semi").select(*keys, "lr", "step", "accuracy", "row_id")


def training_curves(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Mean curve over seeds by ordinal position, starting at step 0.

    The start is the base model for training from scratch and the merged model
    otherwise. ``step`` is that of the first seed.
    """
    keys = [*by, "seed", "task", "role"]
    points = best_sweep(df, cfg, by).select(*keys, "step", pct("accuracy").alias("value"), "row_id")
    base_or_merged = {"from_scratch": cfg.name_of("base"), "from_merged": cfg.name_of("merged")}
    role_of = F.coalesce(*[F.when(F.col("name") == n, F.lit(r)) for r, n in base_or_merged.items()])
    starts = (
        df.filter(F.col("name").isin(list(base_or_merged.values())))
        .withColumn("role", role_of)
        .groupBy(*keys)
        .agg(F.max_by("accuracy", "row_id").alias("accuracy"))
    )
    first = join_on(points.select(*keys).distinct(), starts, keys, "left").select(
        *keys, F.lit(0).cast("bigint").alias("step"), pct(F.coalesce("accuracy", F.lit(0.0))).alias("value"),
        F.lit(-1).cast("bigint").alias("row_id"),
    )
    placed = positions(settle(points.unionByName(first)), keys, ["step", "row_id"], "ordinal")
    return placed.groupBy(*by, "task", "role", "ordinal").agg(
        F.min_by("step", "seed").alias("step"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count(F.lit(1)).alias("n_seeds"),
    )


def converged(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = BY) -> DataFrame:
    """Mean and deviation of the final from-scratch accuracy per task."""
    values = method_values(df, cfg, by).filter(F.col("role") == "from_scratch")
    return values.groupBy(*by, "task").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


# --- cross-model tables --------------------------------------------------------------------------
def setup_label(group: str | Column = "group") -> Column:
    g = F.col(group) if isinstance(group, str) else group
    return F.coalesce(*[F.when(g == k, F.lit(v)) for k, v in SETUP_LABELS.items()], g)


def first_experiment_tasks(df: DataFrame, by: str = "experiment") -> DataFrame:
    """The first experiment's tasks: the columns that combined tables show."""
    first = pin_small(df.agg(F.min(by).alias(by)))
    return settle(df.join(first, by, "left_semi").select("task").distinct())


def combined_results(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = ("experiment", "setup")) -> DataFrame:
    """From-scratch and from-merged finals of every experiment, with pair flags."""
    shown = first_experiment_tasks(df)
    pair = ReportConfig(methods=tuple(m for m in cfg.methods if m.role in ("from_scratch", "from_merged")))
    return flag_pair(mean_std(df, pair, by, shown), by)


def flag_pair(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Which of the two methods is strictly better in each column."""
    side = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    wide = table.groupBy(*by, "task").agg(
        side("from_scratch", "mean").alias("scratch_mean"),
        side("from_scratch", "std").alias("scratch_std"),
        side("from_merged", "mean").alias("merged_mean"),
        side("from_merged", "std").alias("merged_std"),
    )
    return wide.withColumns(
        {
            "scratch_wins": F.col("scratch_mean") > F.col("merged_mean"),
            "merged_wins": F.col("merged_mean") > F.col("scratch_mean"),
        }
    )


def combined_speedup(df: DataFrame, cfg: ReportConfig, by: Sequence[str] = ("experiment", "setup")) -> DataFrame:
    """Normal and strict parity of every experiment, averaged over its own tasks.

    The first experiment's tasks only choose which columns are shown.
    """
    parity = settle(training_to_parity(df, cfg, by))
    both = [_speedup(parity, by, strict).withColumn("strict", F.lit(strict)) for strict in (False, True)]
    return only_shown(both[0].unionByName(both[1]), first_experiment_tasks(df))
