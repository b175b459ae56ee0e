"""Tensor files in the public safetensors format as parameter blocks, and back.

A file is the length of its header, a JSON header with type, shape and place of
every tensor, and the raw values. The driver reads headers only. Values are read
in byte ranges of bounded size, so a tensor of any size is split; small tensors
of a file share a task, as do ranges too small to be worth one each. A file is written by one task as a stream
of blocks; a model larger than ``shard_bytes`` becomes several files.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from graftwork.functions.blocks import FLOATS, Emitter, groups_of, rows_of
from graftwork.operators import merging
from graftwork.operators.scale import settle

BLOCK = 65_536
RANGE_BYTES = 32 * 2**20
READ_BYTES = 4 * 2**20
# Tasks beyond which small ranges share one, up to RANGE_BYTES a task.
TASKS = 200
SHARD_BYTES = 5 * 2**30
HEADER_BYTES = 100 * 2**20
FILE = "adapter_model.safetensors"
DDL = "model string, tensor string, block_no bigint, values_ array<float>, shape array<bigint>"
BLOCKS = pa.schema(
    [("model", pa.string()), ("tensor", pa.string()), ("block_no", pa.int64()), ("values_", FLOATS), ("shape", pa.list_(pa.int64()))]
)
# Names of the format, with their numpy type; BF16 is the upper half of a single-precision number.
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1"}
WRITABLE = ("F32", "F16", "BF16")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") or ":/" not in path:
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)


def floats(raw: bytes, kind: str) -> np.ndarray:
    values = np.frombuffer(raw, TYPES[kind])
    if kind == "BF16":
        return (values.astype("<u4") << 16).view("<f4")
    return values.astype(np.float32)


def stored_bytes(values: np.ndarray, kind: str) -> bytes:
    """Single-precision values in a type of the format, rounded to the nearest, ties to even."""
    values = np.ascontiguousarray(values, "<f4")
    if kind == "BF16":
        bits = values.view("<u4")
        near = ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype("<u2")
        return np.where(np.isnan(values), (bits >> 16) | 0x40, near).astype("<u2").tobytes()
    return values.astype(TYPES[kind]).tobytes()


@dataclass
class Tensor:
    name: str
    kind: str
    shape: list[int]
    begin: int  # place of the first value in the file
    count: int


def read_header(file, size: int, path: str) -> list[Tensor]:
    """Tensors of a file, in the order of their values; raises where the header does not fit the file."""
    start = file.read(8)
    length = struct.unpack("<Q", start)[0] if len(start) == 8 else size
    if length > min(size - 8, HEADER_BYTES):
        raise ValueError(f"{path} has no tensor header")
    try:
        header = json.loads(file.read(length))
    except ValueError as e:
        raise ValueError(f"{path} has no tensor header") from e
    found = []
    for name, entry in header.items():
        if name == "__metadata__":
            continue
        kind, shape, (begin, end) = entry["dtype"], entry["shape"], entry["data_offsets"]
        if kind not in TYPES:
            raise ValueError(f"{path}: type {kind} of {name} is not known")
        count = math.prod(shape)
        if end - begin != count * np.dtype(TYPES[kind]).itemsize or 8 + length + end > size or begin < 0:
            raise ValueError(f"{path}: the values of {name} do not fit its shape or the file")
        found.append(Tensor(name, kind, shape, 8 + length + begin, count))
    return sorted(found, key=lambda t: t.begin)


@dataclass
class Range(InputPartition):
    """Blocks of one file, after each other: (tensor, first block, number of values)."""

    model: str
    path: str
    parts: list[tuple[Tensor, int, int]]


class SafetensorsReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.files = json.loads(options["files"])
        self.block, self.limit = int(options["block"]), int(options["range"])

    def partitions(self) -> Sequence[InputPartition]:
        found = []
        for model, path in self.files:
            system, place = _filesystem(path)
            info = system.get_file_info(place)
            if info.type != pafs.FileType.File:
                raise FileNotFoundError(path)
            with system.open_input_file(place) as file:
                found.append((model, path, read_header(file, info.size, path)))
        total = sum(t.count * np.dtype(TYPES[t.kind]).itemsize for _, _, tensors in found for t in tensors)
        share = max(self.limit, min(RANGE_BYTES, -(-total // TASKS)))
        out = []
        for model, path, tensors in found:
            parts, size = [], 0
            for t in tensors:
                width = np.dtype(TYPES[t.kind]).itemsize
                step = max(1, share // (self.block * width)) * self.block
                for at in range(0, t.count, step):
                    n = min(step, t.count - at)
                    if parts and size + n * width > share:
                        out.append(Range(model, path, parts))
                        parts, size = [], 0
                    parts.append((t, at // self.block, n))
                    size += n * width
            if parts:
                out.append(Range(model, path, parts))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, place = _filesystem(partition.path)
        out = Emitter(BLOCKS)
        with system.open_input_file(place) as file:
            for t, first, n in partition.parts:
                width = np.dtype(TYPES[t.kind]).itemsize
                step = max(1, min(self.limit, READ_BYTES) // (self.block * width)) * self.block
                for at in range(0, n, step):
                    take = min(step, n - at)
                    raw = file.read_at(take * width, t.begin + (first * self.block + at) * width)
                    if len(raw) != take * width:
                        raise ValueError(f"{partition.path} ends before the values of {t.name}")
                    values = floats(raw, t.kind)
                    for k in range(0, take, self.block):
                        number = first + (at + k) // self.block
                        yield from out.add(partition.model, t.name, number, values[k : k + self.block], t.shape)
        yield from out.flush()


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return SafetensorsReader(self.options)


def read_safetensors(
    spark: SparkSession, files: Mapping[str, str | Sequence[str]], block: int = BLOCK, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Blocks of the files of each model: ``model, tensor, block_no, values_, shape``.

    Half-precision and integer values become single precision. Missing and
    broken files are errors. Paths are names or URIs that every executor can open.
    """
    listed = [(m, p) for m, paths in files.items() for p in ([paths] if isinstance(paths, str) else paths)]
    if not listed:
        raise ValueError("no files to read")
    spark.dataSource.register(SafetensorsSource)
    reader = spark.read.format("safetensors").option("files", json.dumps(listed))
    return reader.option("block", block).option("range", range_bytes).load()


def read_adapters(spark: SparkSession, folders: Mapping[str, str], block: int = BLOCK) -> DataFrame:
    """Blocks of the adapters in ``folders`` (model to folder)."""
    return read_safetensors(spark, {m: f"{d.rstrip('/')}/{FILE}" for m, d in folders.items()}, block)


def _shards(sizes: DataFrame, name: str, shard_bytes: int) -> DataFrame:
    """Files of each model: every tensor has its file and place, in the order of names.

    A file takes tensors as long as they begin within its share of the bytes.
    """
    before = Window.partitionBy("model").orderBy("tensor").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("shard", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / shard_bytes))
    order = Window.partitionBy("model").orderBy("shard")
    # Numbers of files without gaps; a tensor larger than a share leaves some out.
    placed = placed.withColumn("shard", F.dense_rank().over(order).cast("bigint"))
    shards = placed.groupBy("model").agg(F.max("shard").alias("shards"))
    stem = name.removesuffix(".safetensors")
    many = F.format_string(f"{stem}-%05d-of-%05d.safetensors", "shard", "shards")
    return placed.join(shards, "model").withColumn("file", F.when(F.col("shards") == 1, F.lit(name)).otherwise(many))


def _write_files(folder: str, kind: str):
    """One file per run of (model, file): header from the run's tensors, then their blocks as they come."""
    width = np.dtype(TYPES[kind]).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (model, file), rows in groups_of(rows_of(batches), ("model", "file")):
            first = next(rows)
            header, at = {}, 0
            for entry in json.loads(first["header"]):
                n = math.prod(entry["shape"]) * width
                header[entry["tensor"]] = {"dtype": kind, "shape": entry["shape"], "data_offsets": [at, at + n]}
                at += n
            text = json.dumps(header, separators=(",", ":")).encode()
            text += b" " * (-len(text) % 8)
            system, place = _filesystem(f"{folder}/{model}")
            system.create_dir(place, recursive=True)
            beside = f"{place}/.{file}-{uuid.uuid4().hex}"
            written = 0
            with system.open_output_stream(beside) as out:
                out.write(struct.pack("<Q", len(text)) + text)
                tensor, number = None, 0
                for row in rows:
                    number = 0 if row["tensor"] != tensor else number + 1
                    tensor = row["tensor"]
                    if row["block_no"] != number:
                        raise ValueError(f"{model} lacks block {number} of {tensor}")
                    if number == 0 and header[tensor]["data_offsets"][0] != written:
                        raise ValueError(f"a tensor before {tensor} of {model} does not fill its shape")
                    raw = stored_bytes(row["values_"], kind)
                    out.write(raw)
                    written += len(raw)
                if written != at:
                    raise ValueError(f"{tensor} of {model} does not fill its shape")
            # A retried task replaces the file by the same one.
            system.move(beside, f"{place}/{file}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([model]), pa.array([file]), pa.array([len(header)], pa.int64()), pa.array([8 + len(text) + at], pa.int64())],
                ["model", "file", "tensors", "bytes"],
            )

    return run


def write_safetensors(
    df: DataFrame, folder: str, model: str = "target", kind: str = "F32", name: str = FILE, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Blocks as ``folder/<model>/<name>``; gives one row per file: ``model, file, tensors, bytes``.

    Every block needs the ``shape`` of its tensor, and a tensor all its blocks.
    A model of more than ``shard_bytes`` is written as numbered files.
    """
    if kind not in WRITABLE:
        raise ValueError(f"cannot write {kind}; known: {', '.join(WRITABLE)}")
    if "shape" not in df.columns:
        raise ValueError("tensor files need the shape of every tensor")
    rows = df.select(F.col(model).alias("model"), "tensor", F.col("block_no").cast("bigint").alias("block_no"), "values_", "shape")
    tensors = rows.groupBy("model", "tensor").agg(F.min("shape").alias("shape"), F.max("shape").alias("other"))
    known = F.col("shape").isNotNull() & (F.col("shape") == F.col("other"))
    checked = F.when(known, F.col("shape")).otherwise(F.raise_error(F.concat(F.lit("no single shape for "), F.col("tensor"))).cast("array<bigint>"))
    bytes_ = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x) * np.dtype(TYPES[kind]).itemsize
    placed = settle(_shards(tensors.withColumn("shape", checked).drop("other").withColumn("bytes", bytes_), name, shard_bytes))
    heads = placed.groupBy("model", "file").agg(F.to_json(F.sort_array(F.collect_list(F.struct("tensor", "shape")))).alias("header"))
    nothing = F.array().cast("array<float>").alias("values_")
    heads = heads.select("model", "file", F.lit("").alias("tensor"), F.lit(-1).cast("bigint").alias("block_no"), nothing, "header")
    blocks = rows.drop("shape").join(placed.select("model", "tensor", "file"), ["model", "tensor"])
    blocks = blocks.select("model", "file", "tensor", "block_no", "values_", F.lit(None).cast("string").alias("header"))
    order = ["model", "file", "tensor", "block_no"]
    ready = heads.unionByName(blocks).repartition("model", "file").sortWithinPartitions(*order)
    return settle(ready.mapInArrow(_write_files(folder.rstrip("/"), kind), "model string, file string, tensors bigint, bytes bigint"))


def average_adapter_files(spark: SparkSession, folders: Sequence[str], output: str, kind: str = "F32") -> DataFrame:
    """The plain mean of adapter folders as a new one, with the config of the first; gives the files written."""
    if len(folders) < 2:
        raise ValueError("need at least 2 adapters")
    names = {f"m{k}": d for k, d in enumerate(folders)}
    parent, _, target = output.rstrip("/").rpartition("/")
    recipe = spark.createDataFrame([(target, m, k) for k, m in enumerate(names)], "target string, model string, ord bigint")
    merged = merging.merge(merging.AVERAGE, read_adapters(spark, names), recipe)
    written = write_safetensors(merged, parent, kind=kind)
    (source, here), (system, there) = _filesystem(folders[0].rstrip("/")), _filesystem(output.rstrip("/"))
    with source.open_input_stream(f"{here}/adapter_config.json") as config, system.open_output_stream(f"{there}/adapter_config.json") as out:
        out.write(config.read())
    return written
