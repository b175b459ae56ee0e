"""Run directories: summary and timing tables, grouping by experiment."""

from __future__ import annotations

import csv
import functools
import re
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions.columns import task_of
from graftwork.operators.reports import setup_label
from graftwork.operators.scale import pin_small, settle

SUMMARY_COLUMNS = {
    "name": "string",
    "dataset": "string",
    "lr": "double",
    "checkpoint": "string",
    "step": "double",
    "accuracy": "double",
    "perplexity": "double",
}
TIMING_COLUMNS = {
    "stage": "string",
    "job": "string",
    "subjob": "string",
    "job_type": "string",
    "elapsed_s": "double",
    "cached": "boolean",
}
def _row_id() -> Column:
    """Stored row order: number of the part file, then place in the file.

    Lines of a split are fewer than its bytes, so split start plus line number
    grows through a file. A file that is no part of a set has the number 0.
    """
    meta = F.col("_metadata")
    part = F.regexp_extract(meta["file_name"], r"^part-(\d+)", 1)
    number = F.when(part != "", part.cast("bigint")).otherwise(F.lit(0))
    line = F.monotonically_increasing_id() % F.lit(2**33)
    return (number * F.lit(2**42) + meta["file_block_start"] + line).alias("row_id")


def _decoded(path: Column) -> Column:
    """A path of ``_metadata`` as it was written, without URL encoding."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _same_form(uri: Column) -> Column:
    """Local paths occur with one and with three slashes."""
    return F.regexp_replace(uri, "^file:/+", "file:/")


def _escaped(path: str) -> str:
    return re.sub(r"([{}\[\]*?,\\])", r"\\\1", path)


def _globs(spark: SparkSession, run_dirs: Sequence[str], file: str) -> list[str]:
    """One path pattern for all directories of a parent; parents without the file are left out."""
    by_parent: dict[str, list[str]] = {}
    for d in dict.fromkeys(run_dirs):
        parent, _, name = d.rstrip("/").rpartition("/")
        by_parent.setdefault(parent, []).append(_escaped(name))
    found = []
    for parent, names in by_parent.items():
        one_of = names[0] if len(names) == 1 else "{" + ",".join(names) + "}"
        glob = f"{parent}/{one_of}/{file}"
        try:
            spark.read.text(glob)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found.append(glob)
    return found


def _typed(spark: SparkSession, head: str, paths: list[str], columns: dict[str, str]) -> DataFrame:
    """Files that begin with the line ``head``, parsed with the types of ``columns``.

    The parser knows every column's place and skips the first line itself.
    Lines that are too short, too long or do not parse fail the read.
    """
    names, fields, seen = next(csv.reader([head])), [], set()
    for i, name in enumerate(names):
        # Columns without a name, or with one that came before, are not asked for.
        own = name if name and name.lower() not in seen else f"__{i}"
        seen.add(own.lower())
        fields.append(f"`{own.replace('`', '``')}` {columns.get(own, 'string')}")
    reader = spark.read.schema(", ".join(fields)).option("header", True).option("mode", "FAILFAST")
    rows = reader.option("columnPruning", False).csv(paths)
    given = [F.col(c) if c in names else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    return rows.select(*given, _row_id(), F.col("_metadata.file_path").alias("__file"))


def _tables(spark: SparkSession, run_dirs: Sequence[str], file: str, columns: dict[str, str]) -> DataFrame:
    """Rows of ``file`` in all the directories that have it, by header name, with ``seed``, ``row_id`` and ``__run``.

    The first line of each file is its header, so files may order their columns
    differently or lack some. Files are read by header, one typed scan for each
    distinct one; with a single header, as usual, that is one scan of all folders.
    """
    globs = _globs(spark, run_dirs, file)
    if not globs:
        raise ValueError("no valid seed data found in the given directories")
    lines = spark.read.text(globs).select("value", F.col("_metadata.file_path").alias("file"), "_metadata.file_block_start", _row_id())
    heads = lines.filter("file_block_start = 0").groupBy("file").agg(F.min_by("value", "row_id").alias("head"))
    heads = settle(heads)
    distinct = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]
    if not distinct:
        return _typed(spark, ",".join(columns), globs, columns).select(
            *columns, "row_id", F.lit("").alias("seed"), F.lit("").alias("__run")
        ).limit(0)
    frames = []
    for head in distinct:
        paths = globs
        if len(distinct) > 1:
            files = heads.filter(F.col("head") == head).select(_decoded(F.col("file")).alias("file")).collect()
            paths = [_escaped(r["file"]) for r in files]
        frames.append(_typed(spark, head, paths, columns))
    rows = functools.reduce(DataFrame.unionByName, frames)
    run = F.regexp_replace(_decoded(F.col("__file")), rf"/{re.escape(file)}(?:/[^/]*)?$", "")
    return rows.select(*columns, "row_id", F.regexp_extract(run, "([^/]+)$", 1).alias("seed"), _same_form(run).alias("__run"))


def _summaries(spark: SparkSession, run_dirs: Sequence[str]) -> DataFrame:
    rows = _tables(spark, run_dirs, "summary/summary.csv", SUMMARY_COLUMNS)
    return rows.withColumns({"step": F.col("step").cast("bigint"), "task": task_of("dataset")})


def read_seeds(spark: SparkSession, run_dirs: Sequence[str]) -> DataFrame:
    """Summaries of several seeds stacked; directories without one are skipped.

    Optional columns that a file lacks are null.
    """
    return _summaries(spark, run_dirs).drop("__run")


def read_summary(spark: SparkSession, run_dir: str) -> DataFrame:
    """Summary of one run, with ``task``, ``seed`` and the stored row order."""
    try:
        return read_seeds(spark, [run_dir])
    except ValueError as e:
        raise FileNotFoundError(f"no summary/summary.csv in {run_dir}") from e


def read_timing(spark: SparkSession, run_dirs: Sequence[str] | str) -> DataFrame:
    """Job timings with ``seed`` from the directory name; missing files are skipped."""
    dirs = [run_dirs] if isinstance(run_dirs, str) else run_dirs
    return _tables(spark, dirs, "timing.csv", TIMING_COLUMNS).drop("__run")


def _qualified(spark: SparkSession, path: str) -> str:
    """The full name of a path, with its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:/", at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())


def load_runs(spark: SparkSession, runs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``metrics`` and ``timing`` of discovered runs, with ``experiment`` and ``setup``.

    The run list is one row per run folder; it is read on the driver, as its
    paths are what is read next. Rows get the names of the folder they come
    from, so folders of different roots may have the same last name, which is
    their ``seed``. Timing is null where no run has it.
    """
    listed = runs.select("run_dir", "experiment", "group").collect()
    dirs = [r.run_dir for r in listed]
    names = spark.createDataFrame(
        [(_qualified(spark, r.run_dir), r.experiment, r.group) for r in listed],
        "__run string, experiment string, group string",
    ).distinct()

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(pin_small(names), "__run").withColumn("setup", setup_label("group")).drop("group", "__run")

    metrics = named(_summaries(spark, dirs))
    try:
        return metrics, named(_tables(spark, dirs, "timing.csv", TIMING_COLUMNS))
    except ValueError:
        return metrics, None


def write_runs(df: DataFrame, root: str, file: str, run: str = "run") -> list[str]:
    """Rows of many runs, each run as ``root/<run>/<file>``, in one write job; gives the folders.

    Tasks write all runs side by side under one folder. Afterwards each run's
    folder gets its name, which moves no data. Folders that exist are an error.
    """
    spark = df.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    beside = f"{root}/_writing-{uuid.uuid4().hex}"
    df.hint("rebalance", run).write.option("header", True).partitionBy(run).csv(beside)
    fs = hadoop.Path(beside).getFileSystem(conf)
    dirs = []
    for status in fs.listStatus(hadoop.Path(beside)):
        name = status.getPath().getName()
        if not name.startswith(f"{run}="):
            continue
        folder = f"{root}/{unquote(name.removeprefix(f'{run}='))}"
        place = hadoop.Path(f"{folder}/{file}")
        if fs.exists(place):
            raise FileExistsError(f"{folder}/{file}")
        fs.mkdirs(place.getParent())
        fs.rename(status.getPath(), place)
        dirs.append(folder)
    fs.delete(hadoop.Path(beside), True)
    return sorted(dirs)


# A quoted scalar, a plain one up to a comment or (inside brackets) a separator, or one sign of flow style.
_QUOTED = r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\''
_FLOW = re.compile(rf"\s*(?:({_QUOTED})|([{{}}\[\],]|:(?=[\s,{{}}\[\]\"']|$))|((?:[^\s,{{}}\[\]:#]|:(?=\S)|(?<=\S)\#|[ \t](?=[^\s,{{}}\[\]:#]))+)|#.*)")
_SCALAR = re.compile(rf"({_QUOTED})\s*(?:#.*)?$|(.*?)(?:(?:^|\s+)#.*)?$")
_PROPERTY = re.compile(r"(?:[&!]\S*\s+)+(?=\S)|[&!]\S*$")
_KEY = re.compile(rf"({_QUOTED}|[^\s#\"'\[\]{{}},-][^#]*?|-\S[^#]*?)\s*:(?:\s+(.*))?$")


def _unquoted(text: str) -> str:
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if text[:1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    return text


def _flow_values(text: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """Paths and scalars of a flow mapping; what lists hold has no path."""
    signs = [(m[1] or m[2] or m[3], bool(m[1])) for m in _FLOW.finditer(text) if m[1] or m[2] or m[3]]
    path: list[str | None] = []
    opened: list[str] = []
    key, at_value = None, False
    for sign, quoted in signs:
        if not quoted and sign in "{[":
            path.append(key)
            opened.append(sign)
            key, at_value = None, False
        elif not quoted and sign in "}]":
            if not opened:
                return
            opened.pop()
            path.pop()
            key, at_value = None, False
        elif not quoted and sign == ",":
            key, at_value = None, False
        elif not quoted and sign == ":":
            at_value = True
        elif at_value and "[" not in opened:
            yield tuple(k for k in [*path[1:], key] if k is not None), _unquoted(sign)
        else:
            key = _unquoted(sign)


def yaml_value(text: str, *path: str) -> str | None:
    """Scalar under nested keys of a YAML mapping, null if there is none.

    Block and flow mappings, quotes, comments, anchors of scalars and aliases
    to them are read; entries of lists, texts over several lines and documents
    after the first are passed over.
    """
    above: list[tuple[int, str]] = []
    anchors: dict[str, str] = {}
    lines = text.splitlines()
    at, folded = 0, None
    while at < len(lines):
        line = lines[at].rstrip()
        at += 1
        body = line.strip()
        indent = len(line) - len(line.lstrip())
        if not body or body.startswith(("#", "%")) or (folded is not None and indent > folded):
            continue
        folded = None
        if body == "---":
            if above:
                break
            continue
        if body == "...":
            break
        found = _KEY.match(body)
        if body.startswith("- ") or not found:
            if body.startswith("-"):
                folded = indent  # what belongs to an entry lies deeper
            elif body.startswith("{"):
                found = None
            if not body.startswith("{"):
                continue
        while above and above[-1][0] >= indent:
            above.pop()
        value = body
        if found:
            above.append((indent, _unquoted(found[1])))
            value = (found[2] or "").strip()
        here = tuple(k for _, k in above)
        anchor = re.match(r"(?:!\S*\s+)*&(\S+)", value)
        value = _PROPERTY.sub("", value, count=1) if value[:1] in ("&", "!") else value
        if value[:1] in ("|", ">"):
            folded = indent
            if here == path:
                return None
            continue
        if value[:1] in ("{", "["):
            while not _closed(value) and at < len(lines):
                value += "\n" + lines[at]
                at += 1
            for inner, scalar in _flow_values(value):
                if here + inner == path:
                    return scalar or None
            continue
        quoted, plain = _SCALAR.match(value).groups()
        scalar = _unquoted(quoted) if quoted else anchors.get(plain[1:], plain) if plain[:1] == "*" else plain
        if anchor:
            anchors[anchor[1]] = scalar
        if here == path and found:
            return None if not quoted and scalar in ("", "~", "null") else scalar or None
    return None


def _closed(flow: str) -> bool:
    """Whether all brackets outside quotes and comments are closed."""
    signs = [m[2] for m in _FLOW.finditer(flow) if m[2]]
    return sum(x in "{[" for x in signs) <= sum(x in "}]" for x in signs)


def discover_runs(spark: SparkSession, root: str, group: str = "all") -> DataFrame:
    """Runs under ``root`` by experiment: ``experiment, group, run_dir``.

    Only directories with a ``pipeline.yaml`` whose ``stages.analysis.config``
    names a group count.
    """
    raw = spark.read.text(f"{root}/*/pipeline.yaml", wholetext=True)
    found = raw.select("value", F.regexp_replace(_decoded(F.col("_metadata.file_path")), "/pipeline\\.yaml$", "").alias("run_dir"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("value").to_pylist()
            names = [yaml_value(t, "experiment_name") or "unknown" for t in texts]
            groups = [yaml_value(t, "stages", "analysis", "config", "group") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(groups, pa.string()), batch.column("run_dir")],
                ["experiment", "group", "run_dir"],
            )

    runs = found.mapInArrow(describe, "experiment string, group string, run_dir string")
    return group_runs(runs.filter(F.col("group").isNotNull()), group)


def group_runs(runs: DataFrame, group: str = "all") -> DataFrame:
    """Runs of the group in (experiment, directory) order."""
    return (runs if group == "all" else runs.filter(F.col("group") == group)).orderBy("experiment", "run_dir")
