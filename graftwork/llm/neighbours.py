"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one and hashed by floors of random projections, in
several tables. A query visits in every table its own bucket and then perturbed
ones, in the order of their estimated chance. Vectors of all visited buckets
are compared exactly and the candidates of the tables merged.

* Equal vectors form one class, so a vector with very many copies is one entry.
* Buckets are cut into blocks of bounded size on both sides; a block of vectors
  meets a block of queries in one matrix product.
* Classes are numbered in the order of (smallest id, vector), so two vectors
  under one id stay apart and ties still go to the smaller id.
* The number of probes is set by measuring recall for a bounded sample of
  queries against all vectors; every vector is indexed. Where too many probes
  would be needed, buckets get coarser, in the end one bucket for all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftwork.llm.common import stored, table
from graftwork.llm.registry import query
from graftwork.llm.words import BASE, mix

TABLES = 4
WIDTH = 2.5
SEED = 11
SAMPLE = 64
TARGET = 0.96
MAX_PROBES = 2_000
BLOCK = 2_048


@dataclass
class Hashing:
    """Random projections of one dimension, drawn from a seed."""

    functions: int
    probes: int = 1
    tables: int = TABLES
    width: float = WIDTH

    def places(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, functions) positions in units of the bucket width."""
        rng = np.random.default_rng([SEED, unit.shape[1], self.functions])
        a = rng.normal(size=(unit.shape[1], self.tables * self.functions))
        shift = rng.random(self.tables * self.functions)
        return (unit @ a / self.width + shift).reshape(len(unit), self.tables, self.functions)

    def keys(self, cells: np.ndarray, dimension: int) -> np.ndarray:
        """64-bit bucket keys of integer cells (..., tables, functions)."""
        key = np.arange(1, self.tables + 1, dtype=np.uint64) + np.uint64(dimension * 1000)
        key = np.broadcast_to(key, cells.shape[:-1])
        for k in range(self.functions):
            key = mix(key * BASE + cells[..., k].astype(np.int64).view(np.uint64))
        return key.view(np.int64)


def probe_order(place: np.ndarray, most: int) -> list[np.ndarray]:
    """Cells of one table in order of the estimated chance of holding a near vector.

    A perturbation costs the squared distances to the cell borders it crosses.
    """
    base = np.floor(place).astype(np.int64)
    inside = place - base
    moves = sorted(
        [(float(d * d), i, -1) for i, d in enumerate(inside)] + [(float((1 - d) ** 2), i, 1) for i, d in enumerate(inside)]
    )
    if not moves:
        return [base]  # no function: all vectors share one cell
    cells, heap = [base], [(moves[0][0], (0,))]
    while heap and len(cells) < most:
        cost, chosen = heapq.heappop(heap)
        if len({moves[k][1] for k in chosen}) == len(chosen):
            cell = base.copy()
            for k in chosen:
                cell[moves[k][1]] += moves[k][2]
            cells.append(cell)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
    return cells


def usable(vector: Column) -> Column:
    """Not null, with a non-zero component, and all components finite numbers."""

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return F.coalesce(
        vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _matrices(batch: pa.RecordBatch, ids: str = "id") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, by dimension."""
    lists = batch.column("vector")
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with those of ``b``; a pair's value depends on the pair alone."""
    top = np.empty((len(a), len(b)))
    norms = np.sqrt(np.einsum("ij,ij->i", b, b))
    for i, row in enumerate(a):
        top[i] = np.einsum("ij,j->i", b, row) / (norms * math.sqrt(float(np.einsum("i,i->", row, row))))
    return top


def _hashed(classes: DataFrame, hashing: Hashing) -> DataFrame:
    """``key, id, vector`` of every vector in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _matrices(batch):
                cells = np.floor(hashing.places(_unit(vectors))).astype(np.int64)
                keys = hashing.keys(cells, vectors.shape[1])
                part = batch.take(pa.array(rows))
                for t in range(hashing.tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[:, t]), part.column("id"), part.column("vector")], ["key", "id", "vector"]
                    )

    return classes.select("id", "vector").mapInArrow(run, "key long, id long, vector array<double>")


def _probed(queries: DataFrame, hashing: Hashing) -> DataFrame:
    """``key, id, vector`` of every bucket that every query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _matrices(batch):
                places = hashing.places(_unit(vectors))
                for row, place in zip(rows.tolist(), places, strict=True):
                    found = [
                        hashing.keys(np.array(probe_order(place[t], hashing.probes))[:, None, :].repeat(hashing.tables, 1), vectors.shape[1])[:, t]
                        for t in range(hashing.tables)
                    ]
                    keys = pa.array(np.concatenate(found))
                    part = batch.take(pa.array(np.full(len(keys), row)))
                    yield pa.RecordBatch.from_arrays(
                        [keys, part.column("id"), part.column("vector")], ["key", "id", "vector"]
                    )

    return queries.select("id", "vector").mapInArrow(run, "key long, id long, vector array<double>")


def _best(queries: pa.RecordBatch, vectors: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The ``k`` nearest of ``vectors`` for each of ``queries``; ties go to the smaller id."""
    qs, vs, points = [], [], []
    for q_rows, q in _matrices(queries):
        for v_rows, v in _matrices(vectors):
            if q.shape[1] != v.shape[1]:
                continue
            q_ids = queries.column("id").to_numpy()[q_rows]
            v_ids = vectors.column("id").to_numpy()[v_rows]
            order = np.argsort(v_ids)
            v, v_ids = v[order], v_ids[order]
            top = cosines(q, v)
            near = np.argsort(-top, axis=1, kind="stable")[:, :k]
            qs.append(np.repeat(q_ids, near.shape[1]))
            vs.append(v_ids[near].ravel())
            points.append(np.take_along_axis(top, near, 1).ravel())
    cols = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((qs, np.int64), (vs, np.int64), (points, float))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "id", "score"])


FOUND = "query long, id long, score double"


def _tuned(classes: DataFrame, queries: DataFrame, n: int, k: int) -> Hashing:
    """Projections by the number of vectors, probes by measured recall of a sample.

    The sample is at most ``SAMPLE`` queries by a hash of the id; its nearest
    vectors are found among all vectors, in blocks.
    """
    sample = queries.orderBy(F.xxhash64(F.lit(SEED), "least"), "id").limit(SAMPLE).select("id", "vector").toArrow()
    functions = max(2, round(math.log2(max(n, 2)) / 2.6))
    if not sample.num_rows:
        return Hashing(functions)
    known = sample.combine_chunks().to_batches()[0]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                yield _best(known, batch.slice(start, BLOCK), k + 1)

    near = classes.select("id", "vector").mapInArrow(nearest, FOUND).filter("query <> id")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    pairs = near.filter(F.col("r") <= k).join(classes.select("id", "vector"), "id").select("query", "vector").toArrow()
    own = dict(zip(known.column("id").to_pylist(), known.column("vector").to_pylist(), strict=True))
    close: dict[int, list] = {}
    for q, v in zip(pairs.column("query").to_pylist(), pairs.column("vector").to_pylist(), strict=True):
        close.setdefault(q, []).append(v)
    while functions:
        hashing, turns = Hashing(functions), []
        for q, near_q in close.items():
            place = hashing.places(_unit(np.array([own[q]])))[0]
            cells = np.floor(hashing.places(_unit(np.array(near_q)))).astype(np.int64)
            first = np.full(len(near_q), MAX_PROBES)
            for t in range(hashing.tables):
                turn = {c.tobytes(): i for i, c in enumerate(probe_order(place[t], MAX_PROBES))}
                first = np.minimum(first, [turn.get(c[t].tobytes(), MAX_PROBES) for c in cells])
            turns.append(first)
        all_turns = np.sort(np.concatenate(turns)) if turns else np.zeros(1, np.int64)
        need = int(all_turns[min(len(all_turns) - 1, math.ceil(TARGET * len(all_turns)) - 1)]) + 1
        if need <= MAX_PROBES:
            return Hashing(functions, need)
        functions -= 1  # coarser buckets, until the sample is found
    return Hashing(0, tables=1)  # every query meets every vector, in blocks


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row.

    Nearness is the cosine of the original vectors in double precision; ties go
    to the smaller id; a row is no neighbour of itself. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do rows with a
    null id, and only vectors of one length are compared. Rows equal in id and
    vector count once. An id with several vectors has a row for each: each is a
    neighbour with its own score, of the other ones too, and each asks for a
    list of its own. Other columns are ignored; empty tables give no rows.
    """
    rows = df.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = stored(rows, "vectors")
    classes = rows.groupBy("vector").agg(F.min("id").alias("least"), F.max("asks").alias("asks"))
    classes = stored(classes.orderBy("least", "vector").withColumn("id", F.monotonically_increasing_id()), "classes")
    asked = classes.filter("asks").select("id", "least", "vector")
    hashing = _tuned(classes, asked, classes.count(), k)

    index = stored(_hashed(classes, hashing), "index")
    probes = stored(_probed(asked, hashing), "probes")
    # How many blocks either side of a bucket is cut into.
    sizes = index.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("vectors_in"))
    asks = probes.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("queries_in"))
    cuts = stored(sizes.join(asks, "key"), "cuts")

    def spread(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one block of its side, once for every block of the other side."""
        return (
            side.join(cuts, "key")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .withColumn("mine", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        )

    left = spread(index, "vectors_in", "queries_in").select("key", F.col("mine").alias("v_part"), F.col("other").alias("q_part"), "id", "vector")
    right = spread(probes, "queries_in", "vectors_in").select("key", F.col("other").alias("v_part"), F.col("mine").alias("q_part"), "id", "vector")

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return pa.Table.from_batches([], pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))
        a, b = (t.combine_chunks().to_batches()[0] for t in (queries, vectors))
        return pa.Table.from_batches([_best(a, b, k + 1)])

    by = ["key", "v_part", "q_part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, FOUND)
    merged = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    merged = merged.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    merged = stored(merged.select("query", "id", "score"), "merged")

    # From classes back to rows: the smallest k + 1 ids of a class are enough for any query.
    named = rows.join(classes.select("vector", F.col("id").alias("class")), "vector")
    named = stored(named.groupBy("class", "id").agg(F.max("asks").alias("asks")), "named")
    least = Window.partitionBy("class").orderBy("id")
    members = named.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k + 1)
    members = stored(members.select("class", "id"), "members")
    asking = stored(named.filter("asks").select(F.col("class").alias("query"), F.col("id").alias("query_id")), "asking")
    lists = (
        merged.join(members.withColumnRenamed("id", "vec_id").withColumnRenamed("class", "id"), "id")
        .withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "id")))
        .filter(F.col("r") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", F.col("id").alias("class")))).alias("near"))
    )
    near = F.filter("near", lambda x: (x["vec_id"] != F.col("query_id")) | (x["class"] != F.col("query")))
    return (
        asking.join(stored(lists, "lists"), "query")
        .select("query_id", F.posexplode(F.slice(near, 1, k)).alias("p", "x"))
        .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    )


@query("op9_multiprobe_neighbours")
def op9_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
