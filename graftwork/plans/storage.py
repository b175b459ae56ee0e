"""Queries that write a table, read it back, and compare."""

from __future__ import annotations

import contextlib
import errno
import itertools
import os
import random
import re
import shutil
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.operators import merging as M
from graftwork.operators import planning as G
from graftwork.operators import ranking as R
from graftwork.operators import timing as T
from graftwork.operators import tokens as K
from graftwork.plans import chatting, merging, planning
from graftwork.plans.registry import query
from graftwork.plans.selection import _LOO, _RANKED
from graftwork.session import ensure_checkpoint_dir
from graftwork.sources import datasets, evaluations, listing, params, runs, safetensors


def shared_folder(df: DataFrame) -> str:
    """A new folder next to the checkpoints, where every executor can write."""
    ensure_checkpoint_dir(df.sparkSession)
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/roundtrip-{uuid.uuid4()}"


_RUN = "experiment || '_' || seed"


def _write_run_summaries(m: DataFrame, root: str) -> list[str]:
    """One summary folder per run, as an analysis finds them, from one write job."""
    rows = m.select(F.expr(_RUN).alias("run"), "name", "dataset", "lr", "checkpoint", "step", "accuracy")
    return runs.write_runs(rows, root, "summary/summary.csv")


_SUMMARY_SQL = "SELECT {seed} AS seed, name, dataset, task, lr, checkpoint, step, accuracy FROM run_metrics"
_SUMMARY_COLS = ("seed", "name", "dataset", "task", "lr", "checkpoint", "step", "accuracy")


@query("S4_read_summary", "run_metrics", sql=_SUMMARY_SQL.format(seed="'whole'"))
def summary(m):
    root = shared_folder(m)
    rows = m.select("name", "dataset", "lr", "checkpoint", "step", "accuracy")
    evaluations.write_csv(rows, f"{root}/whole/summary/summary.csv")
    return runs.read_summary(m.sparkSession, f"{root}/whole").select(*_SUMMARY_COLS)


@query("S5_read_seeds", "run_metrics", sql=_SUMMARY_SQL.format(seed=_RUN))
def seeds(m):
    root = shared_folder(m)
    dirs = _write_run_summaries(m, root)
    # A folder without a summary is skipped.
    return runs.read_seeds(m.sparkSession, [*dirs, f"{root}/empty"]).select(*_SUMMARY_COLS)


@query("U2_stack_seeds", "run_metrics", sql=f"SELECT {_RUN} AS seed, COUNT(*) AS n FROM run_metrics GROUP BY 1")
def stacked(m):
    dirs = _write_run_summaries(m, shared_folder(m))
    return runs.read_seeds(m.sparkSession, dirs).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S6_read_timing",
    "job_timing",
    sql="SELECT 'run0' AS seed, stage, job, subjob, job_type, elapsed_s, cached FROM job_timing",
)
def timing(t):
    root = shared_folder(t)
    rows = t.select("stage", "job", "subjob", "job_type", "elapsed_s", "cached")
    evaluations.write_csv(rows, f"{root}/run0/timing.csv")
    back = T.parse_jobs(runs.read_timing(t.sparkSession, f"{root}/run0"))
    return back.select("seed", "stage", "job", "subjob", "job_type", "elapsed_s", "cached")


@query("S7_load_dataset", "mcq_piqa", sql=chatting._PIQA.replace("SELECT id, ", "SELECT ").replace(", 2 AS n_messages", ""))
def loaded(df):
    root = shared_folder(df)
    datasets.write_dataset(df.select("goal", "sol1", "sol2", "label", "split"), f"{root}/piqa")
    rows = datasets.preprocess(datasets.load_dataset(df.sparkSession, "piqa", root), "piqa")
    return rows.select(
        "split",
        F.element_at("messages", 1)["content"].alias("user_text"),
        F.element_at("messages", 2)["content"].alias("answer"),
    )


@query(
    "S8_select_splits",
    "mcq_hella",
    sql="SELECT split, COUNT(*) AS n FROM mcq_hella WHERE split = 'test' GROUP BY split",
)
def splits(df):
    picked = datasets.select_splits(df, ["test", "dev"])
    return datasets.pick_eval_split(picked, "test").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S10_write_dataset",
    "mcq_hella",
    sql=f"SELECT id, split, answer FROM ({chatting._HELLA}) q WHERE answer IS NULL OR answer <> ''",
)
def written(df):
    root = shared_folder(df)
    raw = df.withColumn("endings", F.array("e0", "e1", "e2", "e3"))
    datasets.write_dataset(datasets.preprocess(raw, "hellaswag"), root)
    back = df.sparkSession.read.parquet(root)
    return back.select("id", "split", F.element_at("messages", -1)["content"].alias("answer"))


@query(
    "U4_missing_splits",
    "mcq_hella",
    sql="""SELECT split FROM (VALUES ('train'), ('test'), ('dev')) AS v(split)
           WHERE split NOT IN (SELECT split FROM mcq_hella)""",
)
def missing(df):
    return datasets.missing_splits(df, ["train", "test", "dev"])


@query(
    "S9_read_params",
    "param_blocks",
    sql=f"""WITH {merging._ELEMENTS} SELECT model, tensor, block_no, COUNT(*) AS n, ROUND(SUM(v), 6) + CAST(0 AS DOUBLE) AS total
            FROM e WHERE model IN ('m1', 'm2') GROUP BY model, tensor, block_no""",
)
def blocks(p):
    root = shared_folder(p)
    params.write_params(p, root, "model")
    back = params.read_params(p.sparkSession, root, ["m1", "m2"])
    total = F.aggregate("values_", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("model", "tensor", "block_no", F.size("values_").cast("bigint").alias("n"), F.round(total, 6).alias("total"))


@query(
    "S13_write_params",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {merging._RECIPE}, {merging._ELEMENTS}
            SELECT target, tensor, block_no, pos, {merging._ROUND.format('AVG(v)')} AS value
            FROM r JOIN e USING (model) GROUP BY target, tensor, block_no, pos
            UNION ALL SELECT model AS target, tensor, block_no, pos, {merging._ROUND.format('v')} AS value FROM e""",
)
def merged(docs, p):
    """All merged targets, written into the store that holds the adapters, and the adapters after it."""
    root = shared_folder(p)
    params.write_params(p, root, "model")
    params.write_params(M.average_params(p, merging.recipe(docs), partial=True), root)
    return merging.elements(params.read_params(p.sparkSession, root).withColumnRenamed("model", "target"))


@query(
    "J12_shape_conflicts",
    "param_blocks",
    sql="""WITH s AS (SELECT model, tensor, [64 * COUNT(*), 1] AS shape FROM param_blocks
             WHERE NOT (model = 'm1' AND tensor = 'lm_head.weight' AND block_no = 0) GROUP BY model, tensor)
           SELECT model, tensor, array_to_string(shape, 'x') AS shape FROM s WHERE tensor IN
             (SELECT tensor FROM s GROUP BY tensor HAVING COUNT(DISTINCT shape) > 1)""",
)
def conflicts(p):
    """Shapes as they were stored with the blocks."""
    cut = p.filter("NOT (model = 'm1' AND tensor = 'lm_head.weight' AND block_no = 0)")
    sizes = cut.groupBy("model", "tensor").agg(F.array(F.count(F.lit(1)) * 64, F.lit(1).cast("bigint")).alias("shape"))
    root = shared_folder(p)
    params.write_params(cut.join(sizes, ["model", "tensor"]), root, "model")
    stored = params.read_params(p.sparkSession, root).select("model", "tensor", "shape").distinct()
    return M.shape_conflicts(stored).withColumn("shape", F.array_join("shape", "x"))


@query("S11_write_metrics", "eval_docs", sql="SELECT eval_dir, model, dataset, accuracy, nll FROM eval_docs")
def metrics(docs):
    root = shared_folder(docs)
    evaluations.write_metrics(docs.select("eval_dir", "model", "dataset", "accuracy", "nll"), root)
    schema = "eval_dir string, model string, dataset string, accuracy double, nll double"
    return docs.sparkSession.read.schema(schema).json(root)


@query(
    "S12_write_ranking",
    "eval_docs",
    sql=_RANKED.format(order="accuracy DESC", src=_LOO) + "SELECT target_task, eval_dir, accuracy, rank FROM r",
)
def ranking(docs):
    root = shared_folder(docs)
    evaluations.write_ranking(R.rank_models(R.leave_one_out(docs)), root)
    schema = "target_task string, eval_dir string, accuracy double, rank bigint"
    return docs.sparkSession.read.schema(schema).json(root)


@query(
    "S14_discover_runs",
    "run_metrics",
    sql=f"SELECT DISTINCT experiment, grp, {_RUN} AS run_dir FROM run_metrics WHERE grp = 'lora'",
)
def grouped(m):
    found = m.select("experiment", F.col("grp").alias("group"), F.expr(_RUN).alias("run_dir")).distinct()
    return runs.group_runs(found, "lora").withColumnRenamed("group", "grp")


# --- rows on real files and folders -------------------------------------------------
# Entries of a tree that one task makes, and that lie on the disk at once.
TASK_ENTRIES = 10_000
SLICE_ENTRIES = 400_000
# How often a task makes an entry again whose folder another task has replaced.
RETRIES = 5


def _filled(entries: DataFrame) -> DataFrame:
    empty = {"bytes": "bigint", "text": "string", "target": "string"}
    for name, kind in empty.items():
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast(kind))
    return entries.select("path", "kind", *empty)


class _Spares:
    """Makes folders, of the emptied folders of earlier trees as far as these go.

    A folder that gets a new name costs far less than one removed and one made,
    least of all where it stays in the same folder above, as others need not wait.
    The earlier trees lie in ``pool``, shared by all tasks: each begins with its
    own share of them, and goes on with the others'. What another task took is
    passed over.
    """

    def __init__(self, pool: str, task: int, tasks: int):
        self.any = os.path.isdir(pool)
        self._own, self._rest = [], []
        for tree in os.listdir(pool) if self.any else ():
            for name in _gone(os.listdir, f"{pool}/{tree}", []):
                mine = zlib.crc32(os.fsencode(name)) % tasks == task % tasks
                (self._own if mine else self._rest).append(f"{pool}/{tree}/{name}")
        self._found, self._held, self._whole = self._emptied(), None, None
        self._aside, self._moved, self._loose = f"{pool}/{uuid.uuid4()}", 0, []

    def _emptied(self) -> Iterator[str]:
        is_dir = lambda top: os.path.isdir(top) and not os.path.islink(top)
        for top in self._own:
            yield from self._of(top, is_dir(top))
        random.shuffle(self._rest)
        for top in self._rest:
            yield from self._of(top, is_dir(top), others=True)

    def _inside(self, path: str) -> list[tuple[str, bool]]:
        """Some paths in a folder, if there are any, and which are folders; links are not followed."""
        with os.scandir(path) as found:
            return [(entry.path, entry.is_dir(follow_symlinks=False)) for entry in itertools.islice(found, TASK_ENTRIES)]

    def _of(self, path: str, is_dir: bool, others: bool = False) -> Iterator[str]:
        """The folders of a tree, innermost first, each without its files and links."""
        if not is_dir:
            _gone(os.unlink, path)
            return
        before = None
        while entries := _gone(self._inside, path):
            # What another task holds but has not moved yet stays, with the folders above it.
            if set(entries) == before:
                return
            before = set(entries)
            if others:
                random.shuffle(entries)
            for entry in entries:
                yield from self._of(*entry, others)
        if entries is not None:
            yield path

    def _away(self, path: str) -> str:
        """Move a folder with what it holds out of the one above, into the pool."""
        if not self._moved:
            os.mkdir(self._aside)
        self._moved += 1
        to = f"{self._aside}/{self._moved}"
        _gone(lambda p: os.rename(p, to), path)
        return to

    def _folders(self, inside: list[tuple[str, bool]]) -> list[str]:
        """The folders of what is in a folder, which loses its files and links."""
        for entry, is_dir in inside:
            if not is_dir:
                _gone(os.unlink, entry)
        return [entry for entry, is_dir in inside if is_dir]

    def _like(self, count: int) -> tuple[str, list[tuple[str, bool]]] | None:
        """One of the own top folders that holds about so many folders, and all that is in it."""
        if self._whole is None:
            self._whole = {}
            for top in self._own:
                inside = None if os.path.islink(top) or not os.path.isdir(top) else _gone(self._inside, top)
                if inside is not None and len(inside) < TASK_ENTRIES:
                    self._whole.setdefault(sum(is_dir for _, is_dir in inside), []).append((top, inside))
        near = min((n for n in self._whole if n <= 2 * count + 8), key=lambda n: abs(n - count), default=None)
        if near is None:
            return None
        found = self._whole[near].pop()
        if not self._whole[near]:
            del self._whole[near]
        return found

    def refit(self, path: str, names: set[str]) -> None:
        """Turn a top folder of the pool into ``path`` with empty folders of some or all of the names."""
        old, inside = self._like(len(names)) or (None, [])
        if old is None:
            return
        rooms = self._folders(inside)
        for room in rooms:
            while inside := _gone(self._inside, room):
                for inner in self._folders(inside):
                    self._away(inner)
        free = [room for room in rooms if os.path.basename(room) not in names]
        for name in names - {os.path.basename(room) for room in rooms}:
            if free:
                _gone(lambda p, to=f"{old}/{name}": os.rename(p, to), free.pop())
        self._loose.extend(self._away(room) for room in free)
        # It stays a spare one where there is a folder already: make() does the rest.
        with contextlib.suppress(OSError):
            os.rename(old, path)

    def make(self, path: str) -> None:
        """A folder and those above it, where they are not there."""
        while not os.path.isdir(path):
            above = os.path.dirname(path)
            if not os.path.isdir(above):
                self.make(above)
            self._held = self._held or (self._loose.pop() if self._loose else next(self._found, None))
            if self._held is None:
                os.makedirs(path, exist_ok=True)
                return
            try:
                os.rename(self._held, path)
                self._held = None
            except FileNotFoundError:
                # Another task took it, or took the place of an empty folder above.
                self._held = self._held if os.path.isdir(self._held) else None
            except OSError as e:
                if e.errno not in (errno.ENOTEMPTY, errno.EEXIST):
                    raise


def _gone(do, path: str, gone=None):
    """What ``do`` gives for a path, or ``gone`` if that is no longer there."""
    try:
        return do(path)
    except FileNotFoundError:
        return gone


def _second_folders(rows: Iterable[dict]) -> set[str]:
    """Names of the folders that rows of one top folder need directly in it."""
    folders, others = set(), set()
    for row in rows:
        parts = f"{row['path']}".split("/")
        if len(parts) > 2 or (len(parts) == 2 and row["kind"] == "dir"):
            folders.add(parts[1])
        elif len(parts) == 2:
            others.add(parts[1])
    return folders - others - {"", ".", ".."}


def _make_tree(entries: DataFrame, root: str, count: int | None = None) -> str:
    """Write ``path, kind, bytes, text, target`` entries as folders, files and links, in tasks of bounded size.

    Folders of the trees in ``<root>.spare``, if there are any, are used up for it.
    """
    place = re.sub("^file:/+", "/", root)
    entries = _filled(entries)
    tasks = max(1, -(-(entries.count() if count is None else count) // TASK_ENTRIES))

    def write(path, text, size):
        with open(path, "wb", buffering=0) as file:
            file.write(text)
            file.truncate(size or len(text))

    def make(batches):
        spares = _Spares(f"{place}.spare", TaskContext.get().partitionId(), tasks)
        last = empty = None

        def put(row):
            nonlocal last, empty
            path = f"{place}/{row['path']}"
            folder = path if row["kind"] == "dir" else os.path.dirname(path)
            if folder != last:
                spares.make(folder)
                last = folder
            if row["kind"] == "link":
                os.symlink(row["target"], path)
            elif row["kind"] == "file":
                text = (row["text"] or "").encode()
                if not spares.any:
                    write(path, text, row["bytes"])
                    return
                # Beside spare folders empty files are names of one: these come and go without being made.
                _gone(os.unlink, path)
                if text or row["bytes"]:
                    write(path, text, row["bytes"])
                    return
                try:
                    if empty:
                        os.link(empty, path)
                        return
                except OSError:  # it is gone, or has all the names that a file may have
                    pass
                write(path, text, None)
                empty = path

        for batch in batches:
            rows = batch.to_pylist()
            for top, inside in itertools.groupby(rows, lambda row: f"{row['path']}".partition("/")[0]) if spares.any else ():
                names = _second_folders(inside)
                if names and top not in ("", ".", "..") and not os.path.lexists(f"{place}/{top}"):
                    spares.refit(f"{place}/{top}", names)
            for row in rows:
                for _ in range(RETRIES):
                    try:
                        put(row)
                        break
                    except FileNotFoundError:  # another task took the place of the empty folder
                        last = None
                else:
                    put(row)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    ready = entries.repartitionByRange(tasks, "path").sortWithinPartitions("path")
    ready.mapInArrow(make, "n bigint").agg(F.sum("n")).collect()
    return place


def _set_aside(tree: str, following: str) -> None:
    """Make a tree, and what was spare for it, the spare folders of the following one."""
    pool = f"{following}.spare"
    if os.path.isdir(f"{tree}.spare"):
        os.rename(f"{tree}.spare", pool)
    else:
        os.mkdir(pool)
    os.rename(tree, f"{pool}/{os.path.basename(tree)}")
    for name in os.listdir(pool):
        with contextlib.suppress(OSError):  # some are left
            os.rmdir(f"{pool}/{name}")


def _remove_spares(spark: SparkSession, pool: str) -> None:
    """Remove the trees in a pool, in tasks."""

    def remove(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if os.path.isdir(path) and not os.path.islink(path):
                    shutil.rmtree(path)
                elif os.path.lexists(path):
                    os.unlink(path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    tops = [(f"{pool}/{tree}/{name}",) for tree in os.listdir(pool) for name in os.listdir(f"{pool}/{tree}")]
    rows = spark.createDataFrame(tops, "path string").repartition(4 * spark.sparkContext.defaultParallelism)
    rows.mapInArrow(remove, "n bigint").agg(F.sum("n")).collect()
    shutil.rmtree(pool)


def _listed_tree(entries: DataFrame, slice_entries: int | None = None) -> DataFrame:
    """The listing of the tree of ``entries``, stored once.

    Every folder takes a block of the disk. With ``slice_entries`` a larger tree
    without links across its top folders is made, listed and removed in slices
    of whole top folders: about so many entries, or one top folder, lie on the
    disk at once. The folders of a slice become those of the next one, and are
    removed after the last.
    """
    spark, root = entries.sparkSession, shared_folder(entries)
    entries = _filled(entries)
    slices = max(1, -(-entries.count() // slice_entries)) if slice_entries else 1
    top = F.coalesce(F.substring_index("path", "/", 1), F.lit(""))
    dealt = entries.withColumn("slice", F.pmod(F.xxhash64(top), F.lit(slices)))
    dealt = dealt.repartition("slice").sortWithinPartitions("slice", "path") if slices > 1 else dealt
    dealt.write.partitionBy("slice").option("compression", "zstd").parquet(f"{root}/entries")
    stored = spark.read.schema(dealt.schema).parquet(f"{root}/entries")
    sizes = {r["slice"]: r["count"] for r in stored.groupBy("slice").count().collect()}
    place = re.sub("^file:/+", "/", root)
    for k in range(slices):
        part = stored.filter(F.col("slice") == k).drop("slice")
        os.makedirs(f"{place}/tree-{k}", exist_ok=True)
        tree = _make_tree(part, f"{root}/tree-{k}", sizes.get(k, 0))
        found = listing.read_tree(spark, tree, spark.sparkContext.defaultParallelism if slices > 1 else listing.TASKS)
        found.write.mode("append").option("compression", "zstd").parquet(f"{root}/listing")
        if slices > 1:
            _set_aside(tree, f"{place}/tree-{k + 1}")
    if slices > 1:
        _remove_spares(spark, f"{place}/tree-{slices}.spare")
    return spark.read.schema(listing.DDL).parquet(f"{root}/listing")


_SHAPED = """sizes AS (SELECT model, tensor, COUNT(*) AS n FROM param_blocks GROUP BY model, tensor)"""


def _with_shape(p):
    sizes = p.groupBy("model", "tensor").agg(F.array(F.count(F.lit(1)), F.lit(64).cast("bigint")).alias("shape"))
    return p.join(sizes, ["model", "tensor"])


@query(
    "S9_read_tensor_files",
    "param_blocks",
    sql=f"""WITH {merging._ELEMENTS}, {_SHAPED}
            SELECT model, tensor, block_no, COUNT(*) AS n, ROUND(SUM(v), 6) + CAST(0 AS DOUBLE) AS total,
                   any_value(sizes.n) || 'x64' AS shape
            FROM e JOIN sizes USING (model, tensor) WHERE model IN ('m1', 'm2') GROUP BY model, tensor, block_no""",
)
def tensor_files(p):
    """Every model as one tensor file; two of them read in byte ranges of two blocks."""
    root = shared_folder(p)
    safetensors.write_safetensors(_with_shape(p), root, "model")
    files = {m: f"{root}/{m}/{safetensors.FILE}" for m in ("m1", "m2")}
    back = safetensors.read_safetensors(p.sparkSession, files, block=64, range_bytes=512)
    total = F.aggregate("values_", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select(
        "model", "tensor", "block_no", F.size("values_").cast("bigint").alias("n"), F.round(total, 6).alias("total"),
        F.array_join("shape", "x").alias("shape"),
    )


@query(
    "S13_write_tensor_files",
    "eval_docs_m",
    "param_blocks",
    sql=f"""WITH {merging._RECIPE}, {merging._ELEMENTS}
            SELECT target, tensor, block_no, pos, {merging._ROUND.format('AVG(v)')} AS value
            FROM r JOIN e USING (model) GROUP BY target, tensor, block_no, pos""",
)
def merged_files(docs, p):
    """Adapters from files, averaged, written as files and read again."""
    spark, root = p.sparkSession, shared_folder(p)
    written = safetensors.write_safetensors(_with_shape(p), f"{root}/in", "model")
    folders = {r["model"]: f"{root}/in/{r['model']}" for r in written.select("model").distinct().collect()}
    merged = M.merge(M.AVERAGE, safetensors.read_adapters(spark, folders, block=64), merging.recipe(docs), partial=True)
    done = safetensors.write_safetensors(merged, f"{root}/out")
    folders = {r["model"]: f"{root}/out/{r['model']}" for r in done.select("model").distinct().collect()}
    return merging.elements(safetensors.read_adapters(spark, folders, block=64).withColumnRenamed("model", "target"))


@query("S3_checkpoints_of_files", "checkpoint_dirs", sql="""SELECT DISTINCT path, CAST(regexp_extract(path, '/checkpoint-([0-9]+)$', 1) AS BIGINT) AS step
           FROM checkpoint_dirs WHERE regexp_matches(path, '/checkpoint-[0-9]+$')""")  # fmt: skip
def checkpoint_folders(dirs):
    tree = _listed_tree(dirs.withColumn("kind", F.lit("dir")))
    return K.discover_checkpoints(listing.artifacts(tree).filter("is_dir")).select("path", "step")


@query("J6_finished_of_files", "grid_parts", sql=f"WITH {planning._DONE_SQL} SELECT job FROM d")
def finished_folders(parts):
    """Jobs all of whose parts hold the mark of finished work."""
    path = F.concat("job", F.lit("/part-"), "part")
    entries = parts.select(path.alias("path"), F.lit("dir").alias("kind")).unionByName(
        parts.filter("done").select(F.concat(path, F.lit("/.done")).alias("path"), F.lit("file").alias("kind"))
    )
    tree = _listed_tree(entries, SLICE_ENTRIES)
    found = listing.finished_folders(tree).filter(F.col("path").contains("/"))
    return G.done_jobs(found.select(F.substring_index("path", "/", 1).alias("job"), "done"))


@query("J7_retention_of_files", "artifacts", "links", sql=planning._KEPT.format(where="") + "SELECT path, bytes FROM p")
def retained_folders(artifacts, links):
    """Folders with weights and a link inside, files beside them, and the links at the top that protect."""
    inner = lambda name: F.concat("path", F.when(F.col("is_dir"), name).otherwise(""))
    weights = artifacts.select(inner("/checkpoint-1/weights").alias("path"), F.lit("file").alias("kind"), F.col("bytes").cast("bigint"))
    nested = artifacts.filter("is_dir").select(inner("/latest").alias("path"), F.lit("link").alias("kind"), F.lit("./checkpoint-1").alias("target"))
    tops = links.select(F.col("name").alias("path"), F.lit("link").alias("kind"), F.concat(F.lit("./x/../"), "target").alias("target"))
    # The link's own way leads through a folder that has to be there.
    way = artifacts.sparkSession.range(1).select(F.lit("x/y").alias("path"), F.lit("dir").alias("kind"))
    entries = weights.unionByName(nested, True).unionByName(tops, True).unionByName(way, True)
    tree = _listed_tree(entries)
    plan = G.retention_plan(listing.artifacts(tree), listing.links(tree), ["lora_*_lr[0-2]_*", "lora_en_lr3_*"])
    return plan.select("path", "bytes")


def _write_results(docs: DataFrame) -> str:
    """Result documents in folders, and of some models in checkpoint folders under them."""
    body = F.to_json(F.struct("accuracy", "nll", "model", "dataset")).alias("text")

    def files(rows: DataFrame, sub: str) -> DataFrame:
        path = F.concat("eval_dir", F.lit(f"{sub}/eval_results.json")).alias("path")
        return rows.select(path, F.lit("file").alias("kind"), body)

    return _make_tree(files(docs, "").unionByName(files(docs.filter("accuracy > 0.4"), "/checkpoint-3")), shared_folder(docs))


@query(
    "S1_read_result_files",
    "eval_docs",
    sql="""SELECT eval_dir, CAST(NULL AS VARCHAR) AS checkpoint_dir, model, dataset, accuracy, nll FROM eval_docs
           UNION ALL SELECT eval_dir, 'checkpoint-3', model, dataset, accuracy, nll FROM eval_docs WHERE accuracy > 0.4""",
)
def result_files(docs):
    """Result documents in folders and in checkpoint folders under them."""
    root = _write_results(docs)
    back = evaluations.read_eval_results(docs.sparkSession, root, "eval_*", include_checkpoints=True)
    return back.select("eval_dir", "checkpoint_dir", "model", "dataset", "accuracy", "nll")


@query(
    "S2_summary_of_files",
    "eval_docs",
    sql="""WITH d AS (SELECT eval_dir, false AS sub, dataset, accuracy FROM eval_docs
                      UNION ALL SELECT eval_dir, true, dataset, accuracy FROM eval_docs WHERE accuracy > 0.4)
           SELECT 'all' AS name, eval_dir, dataset, accuracy FROM d
           UNION ALL SELECT 'ends', eval_dir, dataset, accuracy FROM d WHERE NOT sub AND eval_dir GLOB 'eval_t1*'""",
)
def summary_of_files(docs):
    root = _write_results(docs)
    back = evaluations.read_eval_results(docs.sparkSession, root, include_checkpoints=True)
    entry = evaluations.SummaryEntry
    rows = evaluations.build_summary(back, [entry("all", "eval_*"), entry("ends", "eval_t1*", include_checkpoints=False)])
    return rows.select("name", "eval_dir", "dataset", "accuracy")


@query(
    "S14_discover_run_files",
    "run_metrics",
    sql=f"SELECT DISTINCT experiment, grp, {_RUN} AS run_dir FROM run_metrics WHERE grp = 'lora'",
)
def described_runs(m):
    """Run folders with their descriptions, found by what the descriptions say."""
    found = m.select("experiment", "grp", F.expr(_RUN).alias("run")).distinct()
    text = F.format_string("experiment_name: '%s'  # name\nstages:\n  analysis:\n    config:\n      group: %s\n", "experiment", "grp")
    entries = found.select(F.concat("run", F.lit("/pipeline.yaml")).alias("path"), F.lit("file").alias("kind"), text.alias("text"))
    runs_ = runs.discover_runs(m.sparkSession, _make_tree(entries, shared_folder(m)), "lora")
    return runs_.select("experiment", F.col("group").alias("grp"), F.regexp_extract("run_dir", "([^/]+)$", 1).alias("run_dir"))
