"""Run folders as tables: what lies in a tree, with sizes and link targets.

The driver lists the top of the tree only; each entry there is listed by a task.
Sizes of folders are sums over their files, made by Spark.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DDL = "path string, kind string, bytes bigint, target string"
ENTRIES = pa.schema([("path", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("target", pa.string())])
DIR, FILE, LINK = "dir", "file", "link"
BATCH = 1_000
TASKS = 200


@dataclass
class Tops(InputPartition):
    names: list[str]


class TreeReader(DataSourceReader):
    """Entries under a root: local folders with their links, or any file system that pyarrow opens."""

    def __init__(self, root: str, tasks: int = TASKS):
        self.root, self.tasks = root, tasks

    def _local(self) -> str | None:
        if ":/" not in self.root:
            return self.root
        return re.sub("^file:/+", "/", self.root) if self.root.startswith("file:/") else None

    def partitions(self) -> Sequence[InputPartition]:
        local = self._local()
        if local is not None:
            names = sorted(os.listdir(local))
        else:
            system, place = pafs.FileSystem.from_uri(self.root)
            names = sorted(i.base_name for i in system.get_file_info(pafs.FileSelector(place)))
        step = max(1, -(-len(names) // self.tasks))
        return [Tops(names[k : k + step]) for k in range(0, len(names), step)] or [Tops([])]

    def read(self, partition: Tops) -> Iterator[pa.RecordBatch]:
        local, rows = self._local(), []
        entries = self._on_disk(local, partition.names) if local is not None else self._elsewhere(partition.names)
        for row in entries:
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    def _on_disk(self, root: str, names: list[str]) -> Iterator[tuple]:
        real = os.path.realpath(root)
        waiting = list(reversed(names))
        while waiting:
            path = waiting.pop()
            place = f"{root}/{path}"
            try:
                info = os.lstat(place)
            except FileNotFoundError:  # gone since it was listed
                continue
            if stat.S_ISLNK(info.st_mode):
                # The place that the link leads to in the end, as a path of the tree where it lies in it.
                target = os.path.realpath(place)
                inside = target == real or target.startswith(real + "/")
                size = os.path.getsize(target) if os.path.isfile(target) else 0
                yield path, LINK, size, os.path.relpath(target, real) if inside else target
            elif stat.S_ISDIR(info.st_mode):
                yield path, DIR, 0, None
                waiting.extend(f"{path}/{name}" for name in sorted(os.listdir(place), reverse=True))
            else:
                yield path, FILE, info.st_size, None

    def _elsewhere(self, names: list[str]) -> Iterator[tuple]:
        system, place = pafs.FileSystem.from_uri(self.root)
        for name in names:
            top = system.get_file_info(f"{place}/{name}")
            found = [top]
            if top.type == pafs.FileType.Directory:
                found += system.get_file_info(pafs.FileSelector(top.path, recursive=True))
            for info in found:
                path = info.path[len(place.rstrip("/")) + 1 :]
                yield path, DIR if info.type == pafs.FileType.Directory else FILE, info.size or 0, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in ENTRIES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, ENTRIES, strict=True)], schema=ENTRIES)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["root"], int(self.options["tasks"]))


def read_tree(spark: SparkSession, root: str, tasks: int = TASKS) -> DataFrame:
    """Everything under ``root``: ``path`` in the tree, ``kind`` (dir, file, link), ``bytes``, ``target`` of a link.

    Links are not followed; their targets are resolved through further links,
    and are paths of the tree where they lie in it. A root that does not exist is an error.
    """
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("root", root.rstrip("/") or "/").option("tasks", tasks).load()


def artifacts(tree: DataFrame) -> DataFrame:
    """``path, is_dir, bytes`` of folders and files; a folder has the bytes of all files and file links in it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    sizes = tree.filter("bytes > 0").select(F.explode(above).alias("path"), "bytes")
    sizes = sizes.groupBy("path").agg(F.sum("bytes").alias("bytes"))
    rows = tree.filter(F.col("kind") != LINK).select("path", (F.col("kind") == DIR).alias("is_dir"))
    return rows.join(sizes, "path", "left").select("path", "is_dir", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def links(tree: DataFrame, nested: bool = False) -> DataFrame:
    """``name, target`` of the links at the top of the tree, or of all of them."""
    found = tree.filter(F.col("kind") == LINK)
    if not nested:
        found = found.filter(~F.col("path").contains("/"))
    return found.select(F.col("path").alias("name"), "target")


def finished_folders(tree: DataFrame, mark: str = ".done") -> DataFrame:
    """``path, done`` of every folder: whether it holds the mark of finished work."""
    marks = tree.filter((F.col("kind") != DIR) & F.col("path").endswith(f"/{mark}"))
    marks = marks.select(F.regexp_replace("path", f"/{re.escape(mark)}$", "").alias("path"), F.lit(True).alias("done")).distinct()
    folders = tree.filter(F.col("kind") == DIR).select("path")
    return folders.join(marks, "path", "left").select("path", F.coalesce("done", F.lit(False)).alias("done"))
