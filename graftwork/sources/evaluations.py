"""Evaluation result documents: reading, summarising, writing."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftwork.functions.columns import glob_filter, is_self_eval, parse_lr

RESULT_FILE = "eval_results.json"
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("exact_match", T.DoubleType()),
        T.StructField("perplexity", T.DoubleType()),
        T.StructField("nll", T.DoubleType()),
        T.StructField("num_samples", T.LongType()),
        T.StructField("num_answer_tokens", T.LongType()),
        T.StructField("checkpoint", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("base_model", T.StringType()),
    ]
)


def _documents(spark: SparkSession, glob: str) -> DataFrame:
    # A truncated document must not become a row of nulls that a filter then drops.
    reader = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST")
    docs = reader.json(glob)
    path = F.col("_metadata.file_path")
    inner = F.regexp_extract(path, r"/(checkpoint-[^/]*)/" + RESULT_FILE + "$", 1)
    outer = F.regexp_extract(path, r"/([^/]+)/(?:checkpoint-[^/]*/)?" + RESULT_FILE + "$", 1)
    return docs.select("*", outer.alias("eval_dir"), F.when(inner != "", inner).alias("checkpoint_dir"))


def read_eval_results(
    spark: SparkSession, run_dir: str, pattern: str = "*", include_checkpoints: bool = False
) -> DataFrame:
    """One row per result document under the directories matching ``pattern``.

    The glob is part of the read path, so other directories are never listed.
    Directories without a document are skipped, a document that is no JSON
    object fails the query; with
    ``include_checkpoints`` the documents of ``checkpoint-*`` subfolders come
    along, marked by ``checkpoint_dir``.
    """
    globs = [f"{run_dir}/{pattern}/{RESULT_FILE}"]
    if include_checkpoints:
        globs.insert(0, f"{run_dir}/{pattern}/checkpoint-*/{RESULT_FILE}")
    parts = []
    for g in globs:
        try:
            parts.append(_documents(spark, g))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not parts:
        raise FileNotFoundError(f"no {RESULT_FILE} under {run_dir}/{pattern}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@dataclass(frozen=True)
class SummaryEntry:
    name: str
    pattern: str
    self_eval_only: bool = False
    include_checkpoints: bool = True


def build_summary(docs: DataFrame, entries: Sequence[SummaryEntry]) -> DataFrame:
    """Label result rows with every entry whose pattern fits their directory.

    A directory may appear under several names. The entries are literal, so
    all patterns are tested while scanning once; there is no join. Columns are
    always the same: name, dataset, lr, checkpoint, step, accuracy, perplexity.
    """
    has = set(docs.columns)
    sub = F.col("checkpoint_dir").isNotNull() if "checkpoint_dir" in has else F.lit(False)
    hits = []
    for e in entries:
        hit = glob_filter("eval_dir", e.pattern)
        if e.self_eval_only:
            hit = hit & is_self_eval("dataset", "model")
        if not e.include_checkpoints:
            hit = hit & ~sub
        hits.append(F.when(hit, F.lit(e.name)))
    rows = docs.withColumn("name", F.explode(F.array_compact(F.array(*hits))))
    opt = lambda c, t: (F.col(c) if c in has else F.lit(None)).cast(t).alias(c)
    return rows.select(
        "name",
        F.coalesce("dataset", F.lit("")).alias("dataset"),
        parse_lr("eval_dir").alias("lr"),
        opt("checkpoint", "string"),
        opt("step", "bigint"),
        opt("accuracy", "double"),
        opt("perplexity", "double"),
        "eval_dir",
    )


def unmatched_entries(docs: DataFrame, entries: Sequence[SummaryEntry]) -> list[str]:
    """Names of entries without any matching directory; warns about them."""
    flags = [F.bool_or(glob_filter("eval_dir", e.pattern)).alias(str(i)) for i, e in enumerate(entries)]
    seen = docs.agg(*flags).first()
    missing = [e.name for i, e in enumerate(entries) if not seen[i]]
    for name in missing:
        warnings.warn(f"no directory matches the pattern of '{name}'", stacklevel=2)
    return missing


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows of all checkpoints as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def write_ranking(ranked: DataFrame, path: str) -> None:
    """Full ranking or selection as JSON lines; the choice is a row, not a link."""
    ranked.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
