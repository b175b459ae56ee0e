"""Job grids, skipping of finished work, and retention plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.columns import matches_any
from graftwork.operators.scale import join_on

GIB = 1024**3


def expand_grid(df: DataFrame, axes: Mapping[str, Sequence]) -> DataFrame:
    """Repeat each row for every combination of the listed axis values.

    The lists come with the request, so this is a generator over literals and
    needs neither a join nor a shuffle.
    """
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def job_name(stage: str, *parts: str | Column) -> Column:
    """Stage and axis values joined by underscores."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("_", F.lit(stage), *[c.cast("string") for c in cols])


def grid(spark: SparkSession, axes: Mapping[str, Sequence], stage: str) -> DataFrame:
    """All combinations of the axes with their job names."""
    rows = expand_grid(spark.range(1).drop("id"), axes)
    return rows.withColumn("job", job_name(stage, *axes))


def done_jobs(parts: DataFrame, job: Sequence[str] = ("job",)) -> DataFrame:
    """Jobs whose every part is done."""
    return parts.groupBy(*job).agg(F.bool_and("done").alias("__done")).filter("__done").select(*job)


def pending(jobs: DataFrame, done: DataFrame, keys: Sequence[str] = ("job",)) -> DataFrame:
    return join_on(jobs, done, keys, "left_anti")


def finished(jobs: DataFrame, done: DataFrame, keys: Sequence[str] = ("job",)) -> DataFrame:
    return join_on(jobs, done, keys, "left_semi")


def plain_path(path: str | Column) -> Column:
    """A path without ``.`` parts, doubled or final slashes, and ``..`` after a part it can undo, at any depth."""
    out = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(out, "/"), lambda p: ~p.isin("", "."))
    rooted = out.startswith("/")

    def step(done: Column, part: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1))
        undone = (part == "..") & last.isNotNull() & (last != "..")
        above_root = rooted & (part == "..") & last.isNull()
        return (
            F.when(F.coalesce(undone, F.lit(False)), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(above_root, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(folded, "/"))


def _above(path: str, whole: bool) -> Column:
    """The folders that hold a path, with or without the path itself."""
    parts = F.split(path, "/")
    depth = F.size(parts) if whole else F.size(parts) - 1
    return F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def retention_plan(
    artifacts: DataFrame,
    links: DataFrame,
    patterns: Sequence[str],
    unlink: Sequence[str] = (),
    path: str = "path",
) -> DataFrame:
    """Directories that match a pattern and hold no target of a link.

    A ``*`` of a pattern stops at a slash. Targets are resolved, so ``./b`` and
    ``a/../b`` protect ``b``. Links whose name matches ``unlink`` are gone first
    and protect nothing. A directory inside a planned one goes with it and is
    not listed again. This only plans; nothing is deleted.
    """
    targets = links.filter(~matches_any("name", unlink, paths=True)).select(plain_path("target").alias("__target"))
    held = targets.select(F.explode(_above("__target", whole=True)).alias("__plain")).distinct()
    matching = artifacts.filter(F.col("is_dir") & matches_any(path, patterns, paths=True))
    free = matching.withColumn("__plain", plain_path(path)).join(held, "__plain", "left_anti")
    inside = free.select("__plain", F.explode(_above("__plain", whole=False)).alias("__up"))
    covered = inside.join(free.select(F.col("__plain").alias("__up")), "__up", "left_semi").select("__plain").distinct()
    return free.join(covered, "__plain", "left_anti").drop("__plain")


def retention_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("removed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    ).withColumn("gib", F.col("bytes") / GIB)
