"""Parameter algebra on block tables.

``params(model, tensor, block_no, values_ ARRAY<FLOAT>)`` holds one fixed-length
block per row. All blocks of a merge, the base model included, meet on
``(tensor, block_no)`` in a single shuffle. Only then are they copied to the
targets that selected them, sorted by (target, block, recipe order) and folded
as a stream: a task holds one output block of state, however many models a
recipe lists.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.functions import blocks as B
from graftwork.operators.adapters import adapter_models, onto_base
from graftwork.operators.scale import Pinned, join_on, pin_small, pinned, settle
from graftwork.operators.sparsify import GROUP, settled_vectors, trim_cutoffs

BLOCK = ("tensor", "block_no")
BASE = "__base__"
# Keys that the blocks of one model are dealt to in a join with a recipe that is not broadcast.
SHARES = 32
MODELS_IN_FILTER = 1_000
MERGED_DDL = "target string, tensor string, block_no bigint, values_ array<float>"
AVERAGE, LINEAR, TIES, DARE_TIES = "average", "linear", "ties", "dare_ties"
METHODS = (AVERAGE, LINEAR, TIES, DARE_TIES)


def strip_embeddings(params: DataFrame, adapters: DataFrame | None = None) -> DataFrame:
    """Drop full embedding and head weights; low-rank factors of them stay.

    With ``adapters(model)`` only those models lose them: a full model keeps all
    its tensors.
    """
    t = F.col("tensor")
    full = t.contains("embed_tokens") | t.contains("lm_head")
    factor = t.contains("lora_A") | t.contains("lora_B")
    if adapters is None:
        return params.filter(~full | factor)
    marked = adapters.select("model", F.lit(True).alias("__adapter")).distinct()
    rows = params.join(pin_small(marked), "model", "left")
    return rows.filter(~full | factor | F.col("__adapter").isNull()).drop("__adapter")


def adapters_of(recipe: DataFrame, params: DataFrame) -> DataFrame:
    """The adapters of a recipe: by its ``is_adapter``, or where it says nothing by their tensors."""
    known = recipe.select("model").distinct()
    if "is_adapter" not in recipe.columns:
        return join_on(adapter_models(params), known, ["model"], "left_semi")
    said = recipe.groupBy("model").agg(F.max("is_adapter").alias("is_adapter"))
    told = said.filter("is_adapter").select("model")
    silent = said.filter("is_adapter IS NULL").select("model")
    return told.unionByName(join_on(adapter_models(params), silent, ["model"], "left_semi"))


def normalize_recipe(recipe: DataFrame) -> DataFrame:
    """Fill the default weight and density."""
    cols = set(recipe.columns)
    fill = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1.0)) if c in cols else F.lit(1.0)
    return recipe.withColumns({"weight": fill("weight"), "density": fill("density")})


def absent_models(recipe: DataFrame, params: DataFrame) -> DataFrame:
    """Rows of the recipe whose model has no parameters at all."""
    return recipe.join(params.select("model").distinct(), "model", "left_anti").select(
        "target", "model", F.lit("no parameters").alias("problem")
    )


def recipe_problems(recipe: DataFrame, params: DataFrame) -> DataFrame:
    """Targets with fewer than two models, and models without parameters."""
    few = (
        recipe.groupBy("target")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n < 2")
        .select("target", F.lit(None).cast("string").alias("model"), F.lit("fewer than 2 models").alias("problem"))
    )
    return few.unionByName(absent_models(recipe, params))


def _raise_first(problems: DataFrame) -> None:
    bad = problems.limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.target}/{r.model}: {r.problem}" for r in bad))


def validate_recipe(recipe: DataFrame, params: DataFrame) -> DataFrame:
    """Return the recipe, or raise naming the first problems."""
    _raise_first(recipe_problems(recipe, params))
    return recipe


def merge_gaps(recipe: DataFrame, params: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """What a merge would miss: ``target, model, tensor, block_no, problem``.

    Blocks that some but not all models of a target have, and blocks of models
    that the base lacks. Models without any parameters come without a block.
    """
    k = recipe.groupBy("target").agg(F.countDistinct("model").alias("k"))
    have = params.select("model", *BLOCK).join(recipe.select("target", "model").distinct(), "model")
    partial = have.groupBy("target", *BLOCK).agg(F.count(F.lit(1)).alias("n")).join(k, "target").filter("n < k")
    wanted = partial.select("target", *BLOCK).join(recipe.select("target", "model").distinct(), "target")
    gaps = wanted.join(have, ["target", "model", *BLOCK], "left_anti").select(
        "target", "model", *BLOCK, F.lit("no such block").alias("problem")
    )
    absent = absent_models(recipe, params)
    gaps = gaps.join(absent.select("target", "model"), ["target", "model"], "left_anti").unionByName(
        absent.select("target", "model", F.lit(None).cast("string").alias("tensor"), F.lit(None).cast("bigint").alias("block_no"), "problem")
    )
    if base is None:
        return gaps
    loose = have.select("target", *BLOCK).distinct().join(base.select(*BLOCK), list(BLOCK), "left_anti")
    return gaps.unionByName(
        loose.select("target", F.lit("base").alias("model"), *BLOCK, F.lit("no such block").alias("problem"))
    )


def shape_conflicts(shapes: DataFrame) -> DataFrame:
    """Models whose tensor shape disagrees with that of other models."""
    spread = (
        shapes.groupBy("tensor")
        .agg(F.min("shape").alias("lo"), F.max("shape").alias("hi"))
        .filter("lo <> hi")
        .select("tensor")
    )
    return shapes.join(spread, "tensor", "left_semi")


# --- joins -----------------------------------------------------------------------
@functools.cache
def _subtract():
    @F.arrow_udf("array<float>")
    def subtract(a: pa.Array, b: pa.Array) -> pa.Array:
        diff = a.flatten().to_numpy(zero_copy_only=False).astype("float64") - b.flatten().to_numpy(zero_copy_only=False)
        lengths = np.concatenate([[0], np.cumsum(pc.list_value_length(a).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(diff.astype("float32")))

    return subtract


def _stored(params: DataFrame, partial: bool) -> DataFrame:
    """A block without values is one that its model lacks, where a model may lack blocks."""
    return params.filter(F.size("values_") > 0) if partial else params


def task_vectors(params: DataFrame, base: DataFrame, value: str = "delta", partial: bool = False) -> DataFrame:
    """Single-precision difference to the base model, block by block.

    A block that the base lacks is an error, or with ``partial`` has no difference and is left out.
    """
    params, base = _stored(params, partial), _stored(base, partial)
    b = base.select(*BLOCK, F.col("values_").alias("base_values"))
    if partial:
        return params.join(b, list(BLOCK)).withColumn(value, _subtract()("values_", "base_values"))
    known = F.coalesce("base_values", F.raise_error(F.concat(F.lit("the base lacks block "), F.col("block_no"), F.lit(" of "), F.col("tensor"))))
    rows = params.join(b, list(BLOCK), "left").withColumn("base_values", known.cast("array<float>"))
    return rows.withColumn(value, _subtract()("values_", "base_values"))


def apply_recipe(recipe: DataFrame, params: DataFrame) -> DataFrame:
    """Blocks of the selected models, once per target that selected them.

    A recipe within the row check is broadcast, so the blocks first meet on
    (tensor, block_no) and are copied to their targets without another
    shuffle. A larger recipe joins on the model and a share of its blocks, so a
    model that most targets use is many keys, and shuffles the copies.
    """
    return _meet(params, pinned(normalize_recipe(recipe)), normalize_recipe(recipe))


def _by_model(blocks: DataFrame, models: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the model, whose blocks are dealt to ``SHARES`` keys; ``models`` has a row for each."""
    share = F.pmod(F.xxhash64(*BLOCK), F.lit(SHARES)).cast("int")
    dealt = models.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return blocks.withColumn("__share", share).join(dealt, ["model", "__share"], how).drop("__share")


def _meet(
    blocks: DataFrame, small: Pinned | None, recipe: DataFrame, cuts: DataFrame | None = None
) -> DataFrame:
    """Rows of one (target, tensor, block_no) end up in one task."""
    small_cuts = pinned(cuts) if cuts is not None and small is not None else None
    if small is not None and (cuts is None or small_cuts is not None):
        rows = blocks.repartition(*BLOCK).join(F.broadcast(small.df), "model")
        return rows if cuts is None else rows.join(F.broadcast(small_cuts.df), list(GROUP), "left")
    rows = _by_model(blocks, recipe)
    if cuts is not None:
        rows = rows.join(cuts, list(GROUP), "left")
    return rows.repartition("target", *BLOCK)


def _selected(params: DataFrame, small: Pinned | None, recipe: DataFrame) -> DataFrame:
    """Only the blocks some target uses. A short model list prunes folders."""
    if small is not None:
        models = sorted(set(small.table.column("model").to_pylist()))
        if len(models) <= MODELS_IN_FILTER:
            return params.filter(F.col("model").isin(models))
    models = recipe.select("model").distinct()
    few = pinned(models)
    if few is not None:
        return params.join(F.broadcast(few.df), "model", "left_semi")
    return _by_model(params, models, "left_semi").select(*params.columns)


def _sorted_rows(rows: DataFrame, *extra: str) -> DataFrame:
    rows = rows.sortWithinPartitions("target", *BLOCK, "ord")
    return rows.select("target", "tensor", F.col("block_no").cast("bigint").alias("block_no"), "ord", *extra, "values_")


def _with_counts(recipe: DataFrame) -> DataFrame:
    counts = recipe.groupBy("target").agg(F.count(F.lit(1)).alias("k"))
    return recipe.join(counts, "target")


def _complete(recipe: DataFrame, params: DataFrame) -> DataFrame:
    """The recipe with defaults and model counts; raises on models without parameters.

    Of the parameters only the model column is read, on partitioned tables only
    folder names. The folds raise on single blocks that a model or the base lacks.
    """
    _raise_first(absent_models(recipe, params))
    return _with_counts(normalize_recipe(recipe))


def average_params(params: DataFrame, recipe: DataFrame, partial: bool = False) -> DataFrame:
    """Plain element-wise mean of the selected adapters; weights are ignored.

    The first adapter decides which blocks exist: blocks only others have are
    dropped, a block it has and another adapter lacks is an error, as is a
    model without parameters. With ``partial`` every block is the mean of those
    adapters that have it.
    """
    recipe = _complete(recipe, params)
    small = pinned(recipe)
    rows = _meet(_selected(_stored(params, partial), small, recipe), small, recipe)
    return _sorted_rows(rows, "k").mapInArrow(B.average_stream(partial), MERGED_DDL)


def linear_merge(params: DataFrame, recipe: DataFrame, normalize: bool = True, partial: bool = False) -> DataFrame:
    """Weighted sum of models, divided by the weight total unless told otherwise.

    Every model must have every block that one of them has. With ``partial`` a
    block is summed over those models that have it, and divided by their weights.
    """
    recipe = _complete(recipe, params)
    small = pinned(recipe)
    rows = _meet(_selected(_stored(params, partial), small, recipe), small, recipe)
    return _sorted_rows(rows, "weight", "k").mapInArrow(B.linear_stream(normalize, partial), MERGED_DDL)


def _with_base(recipe: DataFrame) -> DataFrame:
    """The base model joins every target as the row before the first model."""
    base = recipe.select("target", "k").distinct().select(
        "target",
        "k",
        F.lit(BASE).alias("model"),
        F.lit(B.BASE_ORD).cast("bigint").alias("ord"),
        F.lit(0.0).alias("weight"),
        F.lit(1.0).alias("density"),
    )
    cols = ("target", "model", F.col("ord").cast("bigint").alias("ord"), "weight", "density", "k")
    return recipe.select(*cols).unionByName(base)


def _onto_base(params: DataFrame, base: DataFrame, small: Pinned | None, recipe: DataFrame) -> DataFrame:
    """Selected models and the base in one block table: one shuffle, no join."""
    base_rows = base.select(*BLOCK, "values_").withColumn("model", F.lit(BASE))
    wanted = _selected(params, small, recipe).select(*BLOCK, "values_", "model")
    return wanted.unionByName(base_rows)


def _trims(small: Pinned | None, recipe: DataFrame) -> bool:
    if small is not None:
        return any(d < 1 for d in small.table.column("density").to_pylist())
    return recipe.filter("density < 1").limit(1).count() > 0


def ties_merge(
    params: DataFrame, base: DataFrame, recipe: DataFrame, normalize: bool = True, partial: bool = False
) -> DataFrame:
    """Trim task vectors to their density, elect signs, merge onto the base.

    Every model and the base must have every block that one of the models has.
    With ``partial`` the models that have a block elect its signs, and blocks
    that the base lacks are left out, before a density is taken.
    """
    recipe = _with_base(_complete(recipe, params))
    params, base = _stored(params, partial), _stored(base, partial)
    small = pinned(recipe)
    cuts = None
    if _trims(small, recipe):
        source = small.df if small is not None else recipe
        used = source.filter(F.col("density") < 1).select("model", "density").distinct()
        vectors = task_vectors(_selected(params, small, recipe), base, partial=partial).join(used, "model")
        cuts = trim_cutoffs(settled_vectors(vectors))
    rows = _meet(_onto_base(params, base, small, recipe), small, recipe, cuts)
    if cuts is None:
        stream = B.sign_election_stream(normalize, B.keep_all, partial)
        return _sorted_rows(rows, "weight", "k").mapInArrow(stream, MERGED_DDL)
    stream = B.sign_election_stream(normalize, B.keep_largest, partial)
    return _sorted_rows(rows, "weight", "k", "density", "mag", "tie_block", "tie_left").mapInArrow(stream, MERGED_DDL)


def dare_ties_merge(
    params: DataFrame, base: DataFrame, recipe: DataFrame, seed: int = 0, normalize: bool = True, partial: bool = False
) -> DataFrame:
    """Drop task-vector values at random, rescale the rest, then elect signs.

    Every model and the base must have every block that one of the models has.
    With ``partial`` the models that have a block elect its signs, and blocks
    that the base lacks are left out.
    """
    recipe = _with_base(_complete(recipe, params))
    small = pinned(recipe)
    rows = _meet(_onto_base(_stored(params, partial), _stored(base, partial), small, recipe), small, recipe)
    stream = B.sign_election_stream(normalize, B.random_dropper(seed), partial)
    return _sorted_rows(rows, "weight", "k", "density", "model").mapInArrow(stream, MERGED_DDL)


def merge(
    method: str,
    params: DataFrame,
    recipe: DataFrame,
    base: DataFrame | None = None,
    normalize: bool = True,
    seed: int = 0,
    partial: bool = False,
) -> DataFrame:
    """One entry for all methods: validates the recipe, then merges completely or raises.

    With ``partial`` models may lack blocks that others have: a block is merged
    from the models that have it, and left out where a method needs a base that
    lacks it. Their tensors may then differ in the number of rows.

    In linear and task-vector merges adapters lose full embedding and head
    weights; full models keep every tensor, and plain averaging keeps every
    tensor of the first model. What is an adapter says the recipe's
    ``is_adapter``, or the tensors of the model. Where ``params`` has a
    ``shape``, the models of a target must agree on it, tensor by tensor, and
    the result carries it.
    """
    if method not in METHODS:
        raise ValueError(f"unknown merge method {method!r}; known: {', '.join(METHODS)}")
    if method in (TIES, DARE_TIES) and base is None:
        raise ValueError(f"{method} needs a base model")
    validate_recipe(recipe, params)
    kept = params if method == AVERAGE else strip_embeddings(params, adapters_of(recipe, params))
    if method == AVERAGE:
        out = average_params(kept, recipe, partial)
    elif method == LINEAR:
        out = linear_merge(kept, recipe, normalize, partial)
    elif method == TIES:
        out = ties_merge(kept, base, recipe, normalize, partial)
    else:
        out = dare_ties_merge(kept, base, recipe, seed, normalize, partial)
    return with_shapes(out, kept, recipe, method == AVERAGE and not partial, partial) if "shape" in params.columns else out


def merge_onto_base(
    method: str,
    params: DataFrame,
    recipe: DataFrame,
    base: DataFrame,
    scales: DataFrame,
    normalize: bool = True,
    seed: int = 0,
) -> DataFrame:
    """Merge whole models: adapters count as the base with their product added, full models as they are.

    ``scales(model, scale)`` has a row for every adapter of the recipe; its
    other models are full ones. Factors and base tensors need their ``shape``.
    """
    if method not in METHODS:
        raise ValueError(f"unknown merge method {method!r}; known: {', '.join(METHODS)}")
    validate_recipe(recipe, params)
    used = join_on(scales, recipe.select("model").distinct(), ["model"], "left_semi")
    whole = onto_base(params, base, used)
    full = join_on(recipe.select("model").distinct(), used, ["model"], "left_anti")
    rest = params.join(pin_small(full), "model", "left_semi").select(whole.columns)
    models = whole.unionByName(rest)
    if method == AVERAGE:
        return average_params(models, recipe)
    if method == LINEAR:
        return linear_merge(models, recipe, normalize)
    if method == TIES:
        return ties_merge(models, base, recipe, normalize)
    return dare_ties_merge(models, base, recipe, seed, normalize)


def with_shapes(
    merged: DataFrame, params: DataFrame, recipe: DataFrame, first_only: bool = False, partial: bool = False
) -> DataFrame:
    """Merged blocks with the shape of their tensor; raises where the models of a target disagree.

    A tensor may have other shapes in other targets. Shapes of tensors that a
    merge drops are not compared: with ``first_only`` those that the target's
    first model lacks. With ``partial`` they may differ in the first dimension,
    and the largest one counts.
    """
    inner = F.slice("shape", 2, F.greatest(F.size("shape") - 1, F.lit(0)))
    agreed = F.struct(F.size("shape"), inner) if partial else F.col("shape")
    members = recipe.select("target", "model", "ord").distinct()
    shapes = params.filter("shape IS NOT NULL").select("model", "tensor", "shape").distinct()
    by_target = shapes.join(pin_small(members), "model").groupBy("target", "tensor").agg(
        F.max("shape").alias("shape"), (F.min(agreed) != F.max(agreed)).alias("differ"), F.bool_or(F.col("ord") == 0).alias("first")
    )
    by_target = settle(by_target.filter("first") if first_only else by_target)
    bad = by_target.filter("differ").limit(5).collect()
    if bad:
        raise ValueError(f"models disagree on the shape of {', '.join(f'{r.tensor} for {r.target}' for r in bad)}")
    return merged.join(by_target.select("target", "tensor", "shape"), ["target", "tensor"], "left")
