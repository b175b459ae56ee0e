"""Building blocks that keep skewed groups from landing in one task.

* :func:`positions` numbers the rows of every group, however large the group.
* :func:`running_sums` is a prefix sum over gap-free integer positions.
* :func:`pin_small` / :func:`broadcast_checked` broadcast only after counting.
* :func:`join_on` joins on keys where null equals null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftwork.functions.columns import col
from graftwork.session import ensure_checkpoint_dir

PIN_ROWS = 100_000
BROADCAST_ROWS = 1_000_000
RUN_CHUNK = 4_096
RUN_LEVELS = 1
# Groups up to this size are never spread over tasks.
HOT_ROWS = 10_000


class Pinned(NamedTuple):
    """A small control table: as literal rows for joins, and on the driver."""

    df: DataFrame
    table: pa.Table


def pinned(df: DataFrame, max_rows: int = PIN_ROWS) -> Pinned | None:
    """Read a control table if it has at most ``max_rows`` rows, else nothing.

    At most ``max_rows + 1`` rows ever reach the driver.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return Pinned(df.sparkSession.createDataFrame(table, schema=df.schema), table)


def pin_small(df: DataFrame, max_rows: int = PIN_ROWS) -> DataFrame:
    """Broadcast a small control table; a larger one joins through a shuffle."""
    small = pinned(df, max_rows)
    return df if small is None else F.broadcast(small.df)


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the checkpoint folder once.

    For results that are read several times and are far smaller than their
    inputs; it also ends the lineage there.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a stored dimension table, given only after counting it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match each other; the left keys are kept.

    A key that cannot be null on one side uses plain equality, which reuses an
    existing hash partitioning of that key.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})

    def match(k: str) -> Column:
        both_nullable = left.schema[k].nullable and right.schema[k].nullable
        return F.col(k).eqNullSafe(F.col(f"__r_{k}")) if both_nullable else F.col(k) == F.col(f"__r_{k}")

    cond = reduce(lambda a, b: a & b, [match(k) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def hot_groups(df: DataFrame, keys: Sequence[str]) -> Pinned:
    """Keys of the groups that are too large for one task, at most one per shuffle partition.

    Every group beyond the list holds less than a task's fair share of the rows,
    or fewer than ``HOT_ROWS``.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS)
    table = sizes.orderBy(F.col("__n").desc()).limit(most).drop("__n").toArrow()
    schema = df.select(*keys).schema
    return Pinned(df.sparkSession.createDataFrame(table, schema=schema) if table.num_rows else df.select(*keys).limit(0), table)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "row_idx"
) -> DataFrame:
    """Add the 0-based position of each row inside its group.

    ``df`` is read twice: its keys are counted first, so pass a stored table
    where computing it is dear. Groups up to a task's fair share are numbered
    by a window, one shuffle and nothing stored; the hot ones of
    :func:`hot_groups` are range partitioned, see :func:`_spread_positions`.
    ``order`` must make the group's rows distinct.
    """
    hot = hot_groups(df, keys)
    w = Window.partitionBy(*keys).orderBy(*[col(o) for o in order])

    def windowed(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))

    if not hot.table.num_rows:
        return windowed(df)
    few = F.broadcast(hot.df)
    spread = _spread_positions(join_on(df, few, keys, "left_semi"), keys, order, name)
    return windowed(join_on(df, few, keys, "left_anti")).unionByName(spread)


def _spread_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """:func:`positions` of a few groups of any size.

    The rows are range partitioned by (keys, order), so a group with a third of
    the table spreads over a third of the tasks; the position is the place
    inside the task plus the number of earlier rows of the same group. The
    sorted rows go to the checkpoint folder once, so that both readers (counts
    and rows) see the same split even after a lost executor. There are at most
    as many counts as tasks and groups.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sort_cols = [F.col(k) for k in keys] + [col(o) for o in order]
    placed = (
        df.repartitionByRange(*sort_cols)
        .sortWithinPartitions(*sort_cols)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__seq", F.monotonically_increasing_id())
        .checkpoint()
    )
    runs = placed.groupBy("__part", *keys).agg(
        F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__len")
    )
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "__part",
        *keys,
        (F.coalesce(F.sum("__len").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    return (
        join_on(placed, pin_small(runs), ["__part", *keys])
        .withColumn(name, F.col("__seq") + F.col("__shift"))
        .drop("__part", "__seq", "__shift")
    )


def first_rows(
    df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group with their 1-based place.

    A rank filter becomes a per-task limit below the shuffle, but only up to
    Spark's own threshold for it. A larger ``n`` is cut by :func:`positions`,
    which splits a group of any size over tasks.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > limit:
        placed = positions(df, keys, order, "__pos").filter(F.col("__pos") < n)
        return placed.withColumn(name, F.col("__pos") + 1).drop("__pos")
    w = Window.partitionBy(*keys).orderBy(*[col(o) for o in order])
    ranked = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return ranked.withColumn(name, F.col(name).cast("bigint"))


def _earlier_sums(totals: DataFrame, keys: Sequence[str], position: str, cols: Sequence[str], levels: int) -> DataFrame:
    """Exclusive prefix sums ``__b_<col>`` of ``cols``; a list of one key is cut into chunks ``levels`` times."""

    def before(by: Sequence[str], c: str) -> Column:
        w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    if not levels:
        return totals.withColumns({f"__b_{c}": before(keys, c) for c in cols})
    up = f"{position}_up"
    chunked = totals.withColumn(up, F.floor(F.col(position) / RUN_CHUNK))
    upper = chunked.groupBy(*keys, up).agg(*[F.sum(c).alias(c) for c in cols])
    upper = _earlier_sums(upper, keys, up, cols, levels - 1)
    upper = upper.select(*keys, up, *[F.col(f"__b_{c}").alias(f"__u_{c}") for c in cols])
    inside = chunked.withColumns({f"__b_{c}": before([*keys, up], c) for c in cols})
    joined = join_on(inside, upper, [*keys, up])
    return joined.withColumns({f"__b_{c}": F.col(f"__b_{c}") + F.col(f"__u_{c}") for c in cols}).drop(
        up, *[f"__u_{c}" for c in cols]
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], position: str, sums: dict[str, str], levels: int = RUN_LEVELS
) -> DataFrame:
    """Inclusive prefix sums over a gap-free integer position.

    A tree: inside chunks of fixed length, then over the chunk totals, chunked
    ``levels`` times in turn. No task holds more than one chunk of rows or
    totals as long as a key has at most ``RUN_CHUNK ** (levels + 2)`` positions;
    beyond that only the topmost list is longer.
    """
    chunked = df.withColumn("__chunk", F.floor(F.col(position) / RUN_CHUNK))
    inside = (
        Window.partitionBy(*keys, "__chunk")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = chunked.groupBy(*keys, "__chunk").agg(*[F.sum(src).alias(out) for src, out in sums.items()])
    totals = _earlier_sums(totals, keys, "__chunk", list(sums.values()), levels).drop(*sums.values())
    local = chunked.withColumns({out: F.sum(src).over(inside) for src, out in sums.items()})
    joined = join_on(local, totals, [*keys, "__chunk"])
    return joined.withColumns({o: F.col(o) + F.col(f"__b_{o}") for o in sums.values()}).drop(
        "__chunk", *[f"__b_{o}" for o in sums.values()]
    )
