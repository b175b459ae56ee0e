"""Parameter block tables, one partition folder per model."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAM_SCHEMA = "tensor string, block_no bigint, values_ array<float>, shape array<bigint>, model string"


def read_params(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """Blocks of the given models; a model filter prunes whole folders.

    ``shape`` is null where it was not stored.
    """
    try:
        df = spark.read.schema(PARAM_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no parameters at {path}") from e
        raise
    return df.filter(F.col("model").isin(models)) if models else df


def write_params(df: DataFrame, path: str, model: str = "target") -> None:
    """Store blocks under their model names; other models of the store stay.

    A model that is written again is replaced. A ``shape`` column is kept.

    Rebalancing by model keeps the number of files per folder small; adaptive
    execution splits a model that is too large for one task.
    """
    out = df.withColumnRenamed(model, "model") if model != "model" else df
    shape = ["shape"] if "shape" in out.columns else []
    blocks = out.select("model", "tensor", "block_no", "values_", *shape).hint("rebalance", "model")
    writer = blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("model").parquet(path)
