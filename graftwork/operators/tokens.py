"""Token-level evaluation: masks, accuracy, exact match, loss, early stop.

Input is one row per scored token:

``sample_id, pos, label_id, pred_id, nll, is_special`` plus the columns that
name the evaluation (``keys``, by default model, dataset, split, checkpoint,
step). Tokens are first folded to one row per sample; only those narrow rows
are ordered and batched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftwork.functions.columns import checkpoint_step, col
from graftwork.functions.fixed import IGNORE_INDEX
from graftwork.operators.scale import broadcast_checked, first_rows, join_on, pin_small, positions, running_sums, settle

EVAL_KEYS = ("model", "dataset", "split", "checkpoint", "step")


# --- masks --------------------------------------------------------------------
def mask_prompt(ids: str | Column, prompt_len: str | Column) -> Column:
    """Labels of a token array: ignored over the prompt, the ids after it."""
    n = col(prompt_len)
    return F.transform(col(ids), lambda x, i: F.when(i < n, F.lit(IGNORE_INDEX)).otherwise(x))


def trim_trailing(
    tokens: DataFrame,
    vocab: DataFrame,
    sample_keys: Sequence[str],
    prompt_len: str | Column = "prompt_len",
) -> DataFrame:
    """Mask template tokens after the last content token of each answer.

    ``vocab(id, is_special, is_blank)`` says which ids carry no content. Adds
    ``trimmed_label``. The prompt is never entered.
    """
    empty_ids = broadcast_checked(
        vocab.filter("is_special OR is_blank").select(F.col("id").alias("label_id"), F.lit(True).alias("__empty"))
    )
    content = (
        (F.col("pos") >= col(prompt_len))
        & (F.col("label_id") != IGNORE_INDEX)
        & F.col("__empty").isNull()
    )
    # Maximum per sample, then the same partitioning serves the row filter.
    last = F.max(F.when(content, F.col("pos"))).over(Window.partitionBy(*sample_keys))
    in_prompt = F.col("pos") < col(prompt_len)
    return (
        tokens.join(empty_ids, "label_id", "left")
        .withColumn("__last", last)
        .withColumn(
            "trimmed_label",
            F.when(in_prompt | (F.col("pos") > F.coalesce("__last", F.lit(-1))), F.lit(IGNORE_INDEX)).otherwise(
                F.col("label_id")
            ),
        )
        .drop("__last", "__empty")
    )


def answer_tokens(tokens: DataFrame, special_ids: DataFrame | None = None) -> DataFrame:
    """Tokens that count for accuracy: labelled and not special.

    Special ids come from the ``is_special`` flag, or from a ``label_id`` table.
    """
    labelled = tokens.filter(F.col("label_id") != IGNORE_INDEX)
    if special_ids is None:
        return labelled.filter(~F.col("is_special"))
    return labelled.join(broadcast_checked(special_ids.select("label_id").distinct()), "label_id", "left_anti")


def _counts_for_accuracy(tokens: DataFrame) -> Column:
    labelled = F.col("label_id") != IGNORE_INDEX
    return labelled & ~F.col("is_special") if "is_special" in tokens.columns else labelled


def discover_checkpoints(listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows named exactly ``checkpoint-<int>``, in step order."""
    return (
        listing.withColumn("step", checkpoint_step(path)).filter(F.col("step").isNotNull()).orderBy("step", path)
    )


# --- per sample -----------------------------------------------------------------
def sample_stats(tokens: DataFrame, keys: Sequence[str] = EVAL_KEYS) -> DataFrame:
    """One row per sample: loss sum and count, answer and correct token counts.

    The two masks differ: the loss skips ignored labels, accuracy also skips
    special ids.
    """
    labelled = F.col("label_id") != IGNORE_INDEX
    counted = _counts_for_accuracy(tokens)
    aggs = [
        F.count_if(labelled).alias("n_loss"),
        F.count_if(counted).alias("n_answer"),
        F.count_if(counted & (F.col("pred_id") == F.col("label_id"))).alias("n_correct"),
    ]
    if "nll" in tokens.columns:
        aggs.append(F.coalesce(F.sum(F.when(labelled, F.col("nll"))), F.lit(0.0)).alias("nll_sum"))
    return tokens.groupBy(*keys, "sample_id").agg(*aggs)


def head_samples(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First ``n`` samples of each dataset in stored order, for any ``n``.

    A hot dataset never meets in one task as a whole, see :func:`first_rows`.
    """
    if not order:
        raise ValueError("an explicit order is required")
    return first_rows(df, n, keys, order, "__rn").drop("__rn")


def with_batches(
    samples: DataFrame, batch_size: int, keys: Sequence[str], order: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Number the samples of each evaluation and cut them into batches."""
    if not order:
        raise ValueError("batches need an explicit sample order")
    # Read twice: for the sizes of the evaluations, and for the numbers.
    return positions(settle(samples), keys, order, "row_idx").withColumn(
        "batch_id", F.floor(F.col("row_idx") / batch_size)
    )


# --- metrics ----------------------------------------------------------------------
def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def token_accuracy(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correct over answer tokens; 0 when there are none."""
    counted = _counts_for_accuracy(tokens)
    hit = counted & (F.col("pred_id") == F.col("label_id"))
    return (
        tokens.groupBy(*keys)
        .agg(F.count_if(hit).alias("num_correct"), F.count_if(counted).alias("num_answer_tokens"))
        .withColumn("accuracy", F.round(_ratio(F.col("num_correct"), F.col("num_answer_tokens")), 6))
    )


_EXACT = "n_answer > 0 AND n_correct = n_answer"


def _all_samples(stats: DataFrame, samples: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Bring in samples that own no token row at all."""
    if samples is None:
        return stats
    joined = join_on(samples, stats, [*keys, "sample_id"], "left")
    counts = [c for c in ("n_loss", "n_answer", "n_correct", "nll_sum") if c in stats.columns]
    return joined.fillna(0, subset=counts)


def exact_match(tokens: DataFrame, keys: Sequence[str], samples: DataFrame | None = None) -> DataFrame:
    """Samples with every answer token right over all samples."""
    per_sample = _all_samples(sample_stats(tokens, keys), samples, keys)
    return (
        per_sample.groupBy(*keys)
        .agg(F.count_if(F.expr(_EXACT)).alias("num_exact"), F.count(F.lit(1)).alias("num_samples"))
        .withColumn("exact_match", F.round(_ratio(F.col("num_exact"), F.col("num_samples")), 6))
    )


def batch_totals(batched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums per batch; ``batch_nll`` is the mean over the batch's loss tokens."""
    return (
        batched.groupBy(*keys, "batch_id")
        .agg(
            F.sum("n_answer").alias("n_answer"),
            F.sum("n_correct").alias("n_correct"),
            F.count_if(F.expr(_EXACT)).alias("n_exact"),
            F.count(F.lit(1)).alias("n_samples"),
            F.sum("n_loss").alias("n_loss"),
            F.sum("nll_sum").alias("nll_sum"),
        )
        .withColumn("batch_nll", F.col("nll_sum") / F.nullif(F.col("n_loss"), F.lit(0)))
    )


def perplexity(nll: str | Column) -> Column:
    """exp of the mean loss in single precision, 4 decimals."""
    return F.round(F.exp(col(nll).cast("float")).cast("float").cast("double"), 4)


def batch_nll(
    tokens: DataFrame, batch_size: int, keys: Sequence[str], order: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Mean over batches of the batch mean loss; changes with the batch size."""
    batches = batch_totals(with_batches(sample_stats(tokens, keys), batch_size, keys, order), keys)
    mean = F.coalesce(F.avg("batch_nll"), F.lit(0.0))
    return batches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_batches"),
        F.round(mean, 6).alias("nll"),
        perplexity(mean).alias("perplexity"),
    )


def early_stop(batches: DataFrame, keys: Sequence[str], min_accuracy: float | None) -> DataFrame:
    """Drop every batch after the first whose running accuracy is too low.

    That batch itself still counts. Zero or ``None`` turns the rule off. The
    running sums are a tree and the stops (one row per evaluation) are
    broadcast if they are few, so a single huge evaluation still spreads.
    """
    if not min_accuracy:
        return batches
    run = running_sums(batches, keys, "batch_id", {"n_correct": "__correct", "n_answer": "__answer"})
    low = (F.col("__answer") > 0) & (F.col("__correct") / F.nullif(F.col("__answer"), F.lit(0)) < min_accuracy)
    stops = run.groupBy(*keys).agg(F.min(F.when(low, F.col("batch_id"))).alias("__stop"))
    return (
        join_on(batches, pin_small(stops), keys)
        .filter(F.col("__stop").isNull() | (F.col("batch_id") <= F.col("__stop")))
        .drop("__stop")
    )


def evaluate(
    tokens: DataFrame,
    keys: Sequence[str] = EVAL_KEYS,
    batch_size: int = 8,
    order: Sequence[str] = ("sample_id",),
    min_accuracy: float | None = None,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Metric row per evaluation: all models, datasets and checkpoints at once.

    ``samples`` (keys + sample_id) adds samples without token rows to the
    exact-match denominator and to the batch numbering.
    """
    per_sample = _all_samples(sample_stats(tokens, keys), samples, keys)
    batches = batch_totals(with_batches(per_sample, batch_size, keys, order), keys)
    if min_accuracy:
        # The stop rule reads the batch table four times.
        batches = settle(batches)
    used = early_stop(batches, keys, min_accuracy)
    sums = used.groupBy(*keys).agg(
        F.sum("n_correct").alias("c"),
        F.sum("n_answer").alias("num_answer_tokens"),
        F.sum("n_exact").alias("x"),
        F.sum("n_samples").alias("num_samples"),
        F.coalesce(F.avg("batch_nll"), F.lit(0.0)).alias("mean"),
    )
    if min_accuracy:
        sizes = batches.groupBy(*keys).agg(F.sum("n_samples").alias("num_samples"))
        sums = join_on(sums.drop("num_samples"), sizes, keys)
    return sums.select(
        *keys,
        F.round(_ratio(F.col("c"), F.col("num_answer_tokens")), 6).alias("accuracy"),
        F.round(_ratio(F.col("x"), F.col("num_samples")), 6).alias("exact_match"),
        perplexity("mean").alias("perplexity"),
        F.round("mean", 6).alias("nll"),
        "num_samples",
        "num_answer_tokens",
    )
