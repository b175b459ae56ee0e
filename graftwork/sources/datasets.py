"""Multiple-choice datasets: registry, split selection, processed output."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.fixed import DATASET_IDS
from graftwork.operators import chat

_CHOICES = "choices struct<label: array<string>, text: array<string>>"


@dataclass(frozen=True)
class Dataset:
    """Where a dataset lives, its raw schema and its chat template."""

    source: str
    config: str | None
    schema: str
    template: Callable[[DataFrame], DataFrame]


_SCHEMAS = {
    "piqa": ("goal string, sol1 string, sol2 string, label int", chat.piqa),
    "arc_easy": (f"id string, question string, {_CHOICES}, answerKey string", chat.arc_easy),
    "social_iqa": (
        "context string, question string, answerA string, answerB string, answerC string, label string",
        chat.social_iqa,
    ),
    "hellaswag": ("ctx string, endings array<string>, label string", chat.hellaswag),
    "commonsense_qa": (f"id string, question string, {_CHOICES}, answerKey string", chat.commonsense_qa),
    "math_qa": ("Problem string, options string, correct string", chat.math_qa),
    "openbookqa": (f"id string, question_stem string, {_CHOICES}, answerKey string", chat.openbookqa),
    "winogrande": ("sentence string, option1 string, option2 string, answer string", chat.winogrande),
}
REGISTRY = {
    name: Dataset(source, config, *_SCHEMAS[name]) for name, (source, config) in DATASET_IDS.items()
}


def registered(name: str) -> Dataset:
    if name not in REGISTRY:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name]


def load_dataset(spark: SparkSession, name: str, root: str, fmt: str = "parquet") -> DataFrame:
    """Raw rows of a registered dataset, stored under ``root`` by ``split=`` folders."""
    ds = registered(name)
    path = "/".join([root.rstrip("/"), ds.source] + ([ds.config] if ds.config else []))
    schema = ds.schema + ", split string"
    return spark.read.schema(schema).format(fmt).load(path)


def available_splits(df: DataFrame) -> DataFrame:
    return df.select("split").distinct()


def missing_splits(df: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Requested splits the data does not have."""
    asked = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return asked.subtract(available_splits(df))


def select_splits(df: DataFrame, splits: Sequence[str] | None = None) -> DataFrame:
    """Requested splits only; warns about missing ones, fails if none is left.

    The filter is on the partition column, so other splits are not read.
    """
    if not splits:
        return df
    missing = {r.split for r in missing_splits(df, splits).collect()}
    if missing == set(splits):
        raise ValueError("none of the requested splits exists")
    if missing:
        warnings.warn(f"splits not found, skipping: {sorted(missing)}", stacklevel=2)
    return df.filter(F.col("split").isin([s for s in splits if s not in missing]))


def pick_eval_split(
    df: DataFrame, split: str | None = None, default: str | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Rows of the requested split, else the dataset's own, else the first one.

    ``order`` is the stored order of splits (:func:`split_order`); splits it
    does not name come after it, by name.
    """
    wanted = split or default
    if not wanted:
        place = F.coalesce(*[F.when(F.col("split") == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
        wanted = df.agg(F.min_by("split", F.struct(place, F.col("split")))).first()[0]
    rows = df.filter(F.col("split") == wanted)
    if wanted is None or rows.select("split").isEmpty():
        raise ValueError(f"split {wanted!r} not found")
    return rows


def preprocess(df: DataFrame, name: str, observation: Observation | None = None) -> DataFrame:
    """Raw rows to labelled chat rows; source columns survive."""
    return chat.drop_unlabeled(chat.apply_template(df, registered(name).template), observation)


def write_dataset(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Replace the processed dataset, one folder per split.

    ``order`` is kept beside the data, in a folder that readers of the data skip.
    """
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    if order:
        rows = df.sparkSession.createDataFrame(list(enumerate(order)), "place int, split string")
        rows.coalesce(1).write.mode("overwrite").json(f"{path}/_split_order")


def split_order(spark: SparkSession, path: str) -> list[str]:
    """Splits in the order given when the dataset was written; none if it was not given."""
    try:
        rows = spark.read.schema("place int, split string").json(f"{path}/_split_order")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return [r.split for r in rows.orderBy("place").collect()]


def preprocess_all(
    spark: SparkSession, root: str, out: str, splits: Sequence[str] | None = None, fmt: str = "parquet"
) -> dict[str, str]:
    """Process every registered dataset; one that fails does not stop the others."""
    status = {}
    for name in REGISTRY:
        try:
            raw = select_splits(load_dataset(spark, name, root, fmt), splits)
            write_dataset(preprocess(raw, name), f"{out}/{name}")
            status[name] = "ok"
        except Exception as e:  # noqa: BLE001 - reported per dataset
            status[name] = str(e).splitlines()[0]
    return status
