"""Exact magnitude trimming of task vectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftwork.functions import blocks as B
from graftwork.operators.scale import join_on, pin_small, running_sums, settle

GROUP = ("model", "tensor", "density")
_GROUP_FIELDS = [("model", pa.string()), ("tensor", pa.string()), ("density", pa.float64())]
_GROUP_DDL = "model string, tensor string, density double"


def _counts(rows: DataFrame, name: str, pick, keys: tuple[str, ...], ddl: str, fields: list) -> DataFrame:
    """Occurrences of each picked value, counted inside the tasks, then summed.

    Long runs of one group make the partial counts small; any order is right.
    """
    schema = pa.schema([*fields, (name, pa.int64()), ("n", pa.int64())])
    partial = rows.mapInArrow(B.count_values(keys, pick, schema), f"{ddl}, {name} bigint, n bigint")
    return partial.groupBy(*keys, name).agg(F.sum("n").alias("n"))


def _cut(counts: DataFrame, name: str) -> DataFrame:
    """The value (descending) at which the running count reaches ``wanted``.

    A group holds at most 2**16 values, so the window stays small.
    """
    before = Window.partitionBy(*GROUP).orderBy(F.col(name).desc()).rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    hit = (F.col("__before") < F.col("wanted")) & (F.col("wanted") <= F.col("__before") + F.col("n"))
    left = (F.col("wanted") - F.col("__before")).alias("left")
    extra = [c for c in ("bucket",) if c in counts.columns and c != name]
    return running.filter(hit).select(*GROUP, *extra, name, left)


def trim_cutoffs(vectors: DataFrame) -> DataFrame:
    """Per (model, tensor, density): magnitude bits, tie block and tie count.

    ``vectors(model, tensor, density, block_no, delta)``. A sort would send a
    whole tensor through one task. Instead three counting passes find the cut:
    the upper 16 bits of the magnitudes, the lower 16 bits inside the bucket
    that holds the cut, and the ties of that value per block. Exactly
    ``floor(density * n)`` values lie at or before the cut.
    """
    upper = _counts(vectors, "bucket", B.high_bits, GROUP, _GROUP_DDL, _GROUP_FIELDS)
    total = F.sum("n").over(Window.partitionBy(*GROUP))
    upper = upper.withColumn("wanted", F.floor(F.col("density") * total))
    first = pin_small(_cut(upper, "bucket").withColumnRenamed("left", "wanted"))

    inside = vectors.join(first, list(GROUP)).select(*GROUP, "bucket", "wanted", "delta")
    keys = (*GROUP, "bucket", "wanted")
    fields = [*_GROUP_FIELDS, ("bucket", pa.int64()), ("wanted", pa.int64())]
    ddl = f"{_GROUP_DDL}, bucket bigint, wanted bigint"
    lower = _counts(inside, "low", B.low_bits_in_bucket, keys, ddl, fields)
    second = _cut(lower, "low").select(
        *GROUP, (F.col("bucket") * 65536 + F.col("low")).alias("mag"), F.col("left").alias("wanted")
    )

    tie_fields = [*_GROUP_FIELDS, ("mag", pa.int64()), ("wanted", pa.int64()), ("block_no", pa.int64()), ("n", pa.int64())]
    tied = vectors.join(pin_small(second), list(GROUP)).mapInArrow(
        B.count_ties(pa.schema(tie_fields)),
        f"{_GROUP_DDL}, mag bigint, wanted bigint, block_no bigint, n bigint",
    )
    run = running_sums(tied, GROUP, "block_no", {"n": "__upto"})
    before = F.col("__upto") - F.col("n")
    last = run.filter((before < F.col("wanted")) & (F.col("wanted") <= F.col("__upto")))
    return last.select(
        *GROUP, "mag", F.col("block_no").alias("tie_block"), (F.col("wanted") - before).alias("tie_left")
    )


def settled_vectors(vectors: DataFrame) -> DataFrame:
    """Task vectors written to the checkpoint folder, for the counting passes.

    Stored in group order inside each task, so every pass meets long runs.
    """
    rows = vectors.select(*GROUP, F.col("block_no").cast("bigint").alias("block_no"), "delta")
    return settle(rows.sortWithinPartitions(*GROUP))


def trim(vectors: DataFrame) -> DataFrame:
    """Zero all but the largest ``density`` share of each (model, tensor).

    Ties go to the lower (block, position).
    """
    fixed = settled_vectors(vectors)
    rows = join_on(fixed, pin_small(trim_cutoffs(fixed)), GROUP, "left")
    schema = pa.schema([*_GROUP_FIELDS, ("block_no", pa.int64()), ("delta", B.FLOATS)])
    return rows.mapInArrow(B.trim_rows(schema), f"{_GROUP_DDL}, block_no bigint, delta array<float>")
