"""Low-rank adapters as whole models: base weights plus scale x B x A, block by block.

``params`` holds the factors of adapters as blocks with their ``shape``; a
tensor ``x.lora_A`` of (rank, columns) and ``x.lora_B`` of (rows, rank) change
the base tensor ``x.weight``. The product is cut into tiles of columns and bands
of rows, with the rank whole: a tile of A is copied to every band and a band of
B to every tile, which is small beside the product. Products then meet the base
blocks that they fall into, and are added as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.blocks import FLOATS, Emitter, groups_of, rows_of
from graftwork.operators.scale import join_on, pin_small, pinned

TILE = 1024
FACTOR = r"^(?:base_model\.model\.)?(.*)\.lora_([AB])(?:\.\w+)*$"
PIECE_DDL = "model string, tensor string, kind string, unit bigint, at bigint, values_ array<float>"
PIECES = pa.schema([("model", pa.string()), ("tensor", pa.string()), ("kind", pa.string()), ("unit", pa.int64()), ("at", pa.int64()), ("values_", FLOATS)])
PATCH_DDL = "model string, tensor string, block_no bigint, at bigint, values_ array<float>"
PATCHES = pa.schema([("model", pa.string()), ("tensor", pa.string()), ("block_no", pa.int64()), ("at", pa.int64()), ("values_", FLOATS)])
WHOLE_DDL = "model string, tensor string, block_no bigint, values_ array<float>"
WHOLE = pa.schema([("model", pa.string()), ("tensor", pa.string()), ("block_no", pa.int64()), ("values_", FLOATS)])


def adapter_models(params: DataFrame) -> DataFrame:
    """Models that hold a low-rank factor."""
    return params.filter(F.col("tensor").contains("lora_A") | F.col("tensor").contains("lora_B")).select("model").distinct()


def factor_pairs(params: DataFrame) -> DataFrame:
    """One row per (model, base tensor): ``rows, columns, rank`` and block lengths of both factors.

    Raises where a factor has no partner, no shape, or another rank than its partner.
    """
    named = _named(params).groupBy("model", "tensor").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("shape"))).alias(f"shape_{k}") for k in "AB"],
        *[F.max(F.when(F.col("kind") == k, F.size("values_"))).cast("bigint").alias(f"length_{k}") for k in "AB"],
    )
    one, two = F.col("shape_A"), F.col("shape_B")
    fits = (F.size(one) == 2) & (F.size(two) == 2) & (one[0] == two[1])
    bad = named.filter(~F.coalesce(fits, F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.model}/{r.tensor}: factors {r.shape_A} and {r.shape_B} do not fit" for r in bad))
    return named.select("model", "tensor", two[0].alias("rows"), one[1].alias("columns"), one[0].alias("rank"), "length_A", "length_B")


def _named(params: DataFrame) -> DataFrame:
    """Factor blocks under the name of the base tensor that they change."""
    kind = F.regexp_extract("tensor", FACTOR, 2)
    rows = params.withColumn("kind", kind).filter("kind <> ''")
    return rows.withColumn("tensor", F.concat(F.regexp_extract("tensor", FACTOR, 1), F.lit(".weight")))


def _cut(tile: int):
    """Blocks of A by tile of columns, blocks of B by band of rows; ``at`` is the place in the tile or band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(PIECES)
        for row in rows_of(batches):
            columns, rank, values = row["columns"], row["rank"], row["values_"]
            at = row["block_no"] * row["length"]
            stop = at + len(values)
            begin = at
            while at < stop:
                if row["kind"] == "A":
                    line, column = divmod(at, columns)
                    unit = column // tile
                    width = min(tile, columns - unit * tile)
                    end = min(stop, line * columns + unit * tile + width)
                    place = line * width + column - unit * tile
                else:
                    unit, place = divmod(at, tile * rank)
                    end = min(stop, (unit + 1) * tile * rank)
                yield from out.add(row["model"], row["tensor"], row["kind"], unit, place, values[at - begin : end - begin])
                at = end
        yield from out.flush()

    return run


def _multiply(tile: int):
    """Products of a tile and a band, as patches of the base blocks that they fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(PATCHES)
        for (model, tensor, column, line), rows in groups_of(rows_of(batches), ("model", "tensor", "tile", "band")):
            sides, filled = None, 0
            for row in rows:
                if sides is None:
                    width = min(tile, row["columns"] - column * tile)
                    height = min(tile, row["rows"] - line * tile)
                    sides = {"A": np.zeros(row["rank"] * width), "B": np.zeros(height * row["rank"])}
                    shape, length, scale = row, row["block_length"], row["scale"]
                sides[row["kind"]][row["at"] : row["at"] + len(row["values_"])] = row["values_"]
                filled += len(row["values_"])
            rank, columns = shape["rank"], shape["columns"]
            if filled != rank * (width + height):
                raise ValueError(f"{model} lacks blocks of the factors of {tensor}")
            product = scale * (sides["B"].reshape(height, rank) @ sides["A"].reshape(rank, width))
            # A band of whole rows is one run of values, else each row is one.
            runs = [product.ravel()] if width == columns else list(product)
            for k, values in enumerate(runs):
                at = (line * tile + k) * columns + column * tile
                done = 0
                while done < len(values):
                    block, place = divmod(at + done, length)
                    take = min(len(values) - done, length - place)
                    yield from out.add(model, tensor, block, place, values[done : done + take].astype(np.float32))
                    done += take
        yield from out.flush()

    return run


def _add():
    """Base blocks with their patches added; the base comes first of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(WHOLE)
        for (model, tensor, block), rows in groups_of(rows_of(batches), ("model", "tensor", "block_no")):
            first = next(rows)
            if first["at"] >= 0:
                raise ValueError(f"the base lacks block {block} of {tensor}, which {model} changes")
            values = first["values_"].astype(np.float64)
            for row in rows:
                part = slice(row["at"], row["at"] + len(row["values_"]))
                if part.stop > len(values):
                    raise ValueError(f"{model} changes more of {tensor} than the base has")
                values[part] += row["values_"]
            yield from out.add(model, tensor, block, values.astype(np.float32) + np.float32(0))
        yield from out.flush()

    return run


def onto_base(params: DataFrame, base: DataFrame, scales: DataFrame, tile: int = TILE) -> DataFrame:
    """All tensors of the base as each adapter of ``scales(model, scale)`` leaves them: ``model, tensor, block_no, values_``.

    Tensors that an adapter does not change are the base's. Tensors of an
    adapter that are no factors are left out. ``scales`` is a control table
    with one row per model.
    """
    listed = pinned(scales.select("model", F.col("scale").cast("double").alias("scale")).distinct())
    if listed is None:
        raise ValueError("too many adapters at once")
    models = listed.table.column("model").to_pylist()
    own = params.filter(F.col("model").isin(models))
    pairs = factor_pairs(own)
    lengths = base.groupBy("tensor").agg(F.max(F.size("values_")).cast("bigint").alias("block_length"))
    facts = pairs.join(lengths, "tensor", "left").join(F.broadcast(listed.df), "model")
    missing = facts.filter("block_length IS NULL").limit(5).collect()
    if missing:
        raise ValueError("; ".join(f"the base lacks {r.tensor}, which {r.model} changes" for r in missing))
    absent = set(models) - {r["model"] for r in facts.select("model").distinct().collect()}
    if absent:
        raise ValueError(f"no factors for {', '.join(sorted(absent))}")
    facts = pin_small(facts)
    named = _named(own).select("model", "tensor", "kind", "block_no", "values_")
    length = F.when(F.col("kind") == "A", F.col("length_A")).otherwise(F.col("length_B")).alias("length")
    blocks = join_on(named, facts, ["model", "tensor"]).select("model", "tensor", "kind", "block_no", length, "columns", "rank", "values_")
    pieces = join_on(blocks.mapInArrow(_cut(tile), PIECE_DDL), facts, ["model", "tensor"])
    count = lambda c: F.ceil(F.col(c) / tile).cast("bigint") - 1
    others = F.when(F.col("kind") == "A", F.sequence(F.lit(0).cast("bigint"), count("rows"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), count("columns"))
    )
    met = pieces.withColumn("other", F.explode(others))
    met = met.withColumns({
        "tile": F.when(F.col("kind") == "A", F.col("unit")).otherwise(F.col("other")),
        "band": F.when(F.col("kind") == "A", F.col("other")).otherwise(F.col("unit")),
    })
    keys = ["model", "tensor", "tile", "band"]
    met = met.select(*keys, "kind", "at", "rows", "columns", "rank", "block_length", "scale", "values_")
    patches = met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_multiply(tile), PATCH_DDL)
    copies = base.withColumn("model", F.explode(F.array(*[F.lit(m) for m in sorted(models)])))
    copies = copies.select("model", "tensor", F.col("block_no").cast("bigint").alias("block_no"), F.lit(-1).cast("bigint").alias("at"), "values_")
    block = ["model", "tensor", "block_no"]
    return copies.unionByName(patches).repartition(*block).sortWithinPartitions(*block, "at").mapInArrow(_add(), WHOLE_DDL)


def read_scales(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``model, scale, rank, base`` from the ``adapter_config.json`` in the folder of each model.

    The scale is alpha over rank, or over its root where the adapter asks for that.
    """
    schema = "r bigint, lora_alpha double, use_rslora boolean, base_model_name_or_path string"
    frames = []
    for model, path in paths.items():
        config = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/adapter_config.json")
        rank = F.when(F.col("use_rslora"), F.sqrt("r")).otherwise(F.col("r"))
        frames.append(
            config.select(
                F.lit(model).alias("model"), (F.col("lora_alpha") / rank).alias("scale"), F.col("r").alias("rank"),
                F.col("base_model_name_or_path").alias("base"),
            )
        )
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
