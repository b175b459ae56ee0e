"""Packing documents into sequences of fixed length.

Documents are tokenized and cut once; the pieces are stored as narrow rows.
What has to be packed is then only the histogram of piece lengths, which has
``capacity`` entries however large the corpus is. A plan for it is computed
from the configuration linear program (multiplicative weights, priced by
knapsack dynamic programming), rounded down, and completed by best fit. The
plan is a table of at most a few thousand rows; each piece finds its place in
it by its number among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftwork.llm.bpe import WordMerger
from graftwork.llm.chunks import Ragged, TextEncoder, sliced
from graftwork.llm.common import stored, table
from graftwork.llm.registry import query

CAPACITY = 1024
END_ID = 2
ROUNDS = 192
RATE = 2.0

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, part int, nth long"

Pattern = tuple[tuple[int, int], ...]


# ---------------------------------------------------------------- the plan


def best_pattern(value: np.ndarray, limit: np.ndarray, capacity: int) -> Pattern:
    """The most valuable multiset of lengths that fits, by dynamic programming.

    ``value`` and ``limit`` (copies allowed) are indexed by length.
    """
    items: list[tuple[int, int]] = []
    for length in np.flatnonzero(limit > 0).tolist():
        left, lot = min(int(limit[length]), capacity // length), 1
        while left > 0:
            take = min(lot, left)
            items.append((length, take))
            left, lot = left - take, lot * 2
    best = np.zeros(capacity + 1)
    used = np.zeros((len(items), capacity + 1), bool)
    for k, (length, take) in enumerate(items):
        size = length * take
        better = best[:-size] + value[length] * take
        used[k, size:] = better > best[size:]
        best[size:] = np.maximum(best[size:], better)
    room, copies = int(best.argmax()), Counter()
    for k in range(len(items) - 1, -1, -1):
        if used[k, room]:
            length, take = items[k]
            copies[length] += take
            room -= length * take
    return tuple(sorted(copies.items(), reverse=True))


def fractional_plan(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[Pattern, float]:
    """Amounts of patterns that nearly cover ``counts``: the configuration program.

    Every round adds an equal amount of the best pattern under the present
    weights; the weights of the lengths it covers fall by their covered share.
    """
    lengths = np.arange(capacity + 1)
    total = float((counts * lengths).sum()) / capacity
    step = total / rounds
    plan: dict[Pattern, float] = {}
    if step <= 0:
        return plan
    covered = np.zeros(capacity + 1)
    need = np.maximum(counts, 1)
    limit = np.where(counts > 0, np.maximum(1, np.floor(counts / step)), 0).astype(np.int64)
    for done in range(rounds):
        weights = lengths * np.exp(-RATE * (covered / need - done / rounds))
        pattern = best_pattern(weights, limit, capacity)
        plan[pattern] = plan.get(pattern, 0.0) + step
        for length, copies in pattern:
            covered[length] += copies * step
    return plan


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, on the histogram: equal bins are handled together."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        grown: list[tuple[int, Pattern, int]] = []
        for free in range(length, capacity):
            if not left:
                break
            kept = []
            for pattern, n in bins.get(free, []):
                each = free // length
                full = min(n, left // each)
                rest = left - full * each if full < n else 0
                if full:
                    grown.append((free - each * length, (*pattern, (length, each)), full))
                if rest:
                    grown.append((free - rest * length, (*pattern, (length, rest)), 1))
                left -= full * each + rest
                if n - full - bool(rest):
                    kept.append((pattern, n - full - bool(rest)))
            bins[free] = kept
        each = capacity // length
        if left // each:
            grown.append((capacity - each * length, ((length, each),), left // each))
        if left % each:
            grown.append((capacity - left % each * length, ((length, left % each),), 1))
        for free, pattern, n in grown:
            bins.setdefault(free, []).append((pattern, n))
    return [x for group in bins.values() for x in group]


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences follow each; every piece has exactly one place.

    The rounded plan, completed by best fit, or best fit alone where that needs
    fewer sequences: rounding leaves long pieces without short ones beside them.
    """
    alone = best_fit(counts, capacity)
    left, rounded = counts.copy(), []
    left[capacity] = 0
    for pattern, amount in fractional_plan(left.copy(), capacity).items():
        times = min([int(amount), *(int(left[length]) // copies for length, copies in pattern)])
        if times:
            rounded.append((pattern, times))
            for length, copies in pattern:
                left[length] -= copies * times
    left[capacity] = counts[capacity]
    rounded += best_fit(left, capacity)
    return min(rounded, alone, key=lambda plan: sum(n for _, n in plan))


@dataclass
class Places:
    """Where the n-th piece of a length goes: blocks of places, sorted by (length, first piece)."""

    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    by_length: np.ndarray

    @classmethod
    def of(cls, plan: list[tuple[Pattern, int]], capacity: int) -> Places:
        rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
        for pattern, times in plan:
            offset = 0
            for length, copies in pattern:
                rows.append((length, int(taken[length]), copies, sequence, offset))
                taken[length] += copies * times
                offset += copies * length
            sequence += times
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 5).T
        return cls(*cols[1:], np.searchsorted(cols[0], np.arange(capacity + 2)))

    def find(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = np.empty(len(length), np.int64)
        for value in np.unique(length):
            mine = length == value
            a, b = self.by_length[value], self.by_length[value + 1]
            block[mine] = a + np.searchsorted(self.first[a:b], nth[mine], "right") - 1
        into = nth - self.first[block]
        turn, place = into // self.copies[block], into % self.copies[block]
        return self.sequence[block] + turn, self.offset[block] + place * length


# ---------------------------------------------------------------- Spark


# A word of usual letters, and marks behind it: two matches of the pre-tokenizer at most.
WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
LIBRARY_CHUNKS = 4_096


class ChunkIds:
    """Ids of chunks: words by matrices of merges where the tokenizer allows that, everything else by the library."""

    def __init__(self, library, merger: WordMerger | None):
        self.library, self.merger = library, merger

    def by_library(self, chunks: list[str]) -> Ragged:
        flat, lengths = [], []
        for k in range(0, len(chunks), LIBRARY_CHUNKS):
            for found in self.library.encode_batch_fast(chunks[k : k + LIBRARY_CHUNKS], add_special_tokens=False):
                ids = found.ids
                flat += ids
                lengths.append(len(ids))
        return Ragged.of(np.array(flat, np.uint32), np.array(lengths, np.int64))

    def __call__(self, chunks: list[str]) -> Ragged:
        if self.merger is None:
            return self.by_library(chunks)
        words, others, index, parts = [], {}, [], []
        for chunk in chunks:
            m = WORD.fullmatch(chunk)
            if m is None:
                index.append(~others.setdefault(chunk, len(others)))
                parts.append(1)
            else:
                index.append(len(words))
                words.append(m[1].encode())
                if m[2]:
                    index.append(~others.setdefault(m[2], len(others)))
                parts.append(1 + bool(m[2]))
        one, two = self.merger(words), self.by_library(list(others))
        rows = Ragged.of(np.concatenate([one.flat, two.flat]), np.concatenate([one.lengths, two.lengths]))
        at = np.array(index, np.int64)
        flat, ends = rows.take(np.where(at < 0, len(words) + ~at, at))
        stops = np.concatenate([[0], ends])[np.cumsum(parts)]
        return Ragged.of(flat, np.diff(stops, prepend=0))


def cut_documents(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", added_ids: bool = True,
) -> DataFrame:
    """One row per piece, with the number of the piece among its task's pieces of that length.

    Special tokens written in a text have ids of their own, as the tokenizer
    library gives them by default, or without ``added_ids`` are ordinary text.
    Null is the empty text, which is one piece of one end id. Repeated ids give
    pieces for every row.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        source = df.sparkSession.sparkContext.broadcast(file.read())
    fields = PIECES.format(id=df.schema[id_col].dataType.simpleString())
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(source.value)
        library.encode_special_tokens = True
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encoder = TextEncoder(
            ChunkIds(library, WordMerger.of_file(source.value)),
            lambda text: [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)],
        )
        added = {t.content: k for k, t in library.get_added_tokens_decoder().items()} if added_ids else {}
        marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def ids_of(texts: list[str]) -> list[np.ndarray]:
            if marks is None:
                return encoder(texts)
            split = [marks.split(t) if marks.search(t) else [t] for t in texts]
            plain = iter(encoder([x for own in split for x in own[::2]]))
            out = []
            for own in split:
                ids = [next(plain) if k % 2 == 0 else np.array([added[x]], np.uint32) for k, x in enumerate(own)]
                out.append(ids[0] if len(ids) == 1 else np.concatenate(ids))
            return out

        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                at, piece, start, length, crc, nth = [], [], [], [], [], []
                for i, ids in enumerate(ids_of(texts)):
                    data = memoryview(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
                    n = len(data) // 4
                    begin, number = 0, 0
                    while begin < n:
                        stop = begin + ((n - begin) % capacity or capacity)
                        size = stop - begin
                        at.append(i)
                        piece.append(number)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(data[4 * begin : 4 * stop]))
                        nth.append(int(seen[size]))
                        seen[size] += 1
                        begin, number = stop, number + 1
                cols = [
                    rows.column("id").take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    pa.array([part] * len(at), pa.int32()),
                    pa.array(nth, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, fields)


def pack(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", added_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    Every token of every document is in exactly one sequence, and sequences
    have no gaps. An empty table packs into no sequences.
    """
    spark = df.sparkSession
    # Numbers given inside tasks must not change, so the pieces are written before they are counted.
    pieces = stored(cut_documents(df, tokenizer_path, capacity, end_id, id_col, text_col, added_ids), "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(
        counted.select("part", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "counts"
    )
    counts = np.zeros(capacity + 1, np.int64)
    for row in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(Places.of(plan_bins(counts, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, nth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
                sequence, offset = places.value.find(length, nth)
                cols = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:5], "sequence_id", "offset"])

    numbered = pieces.join(before.select("part", "length", "before"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("nth")
    )
    kind = df.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(place, out).withColumnRenamed("doc_id", id_col)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_ids=True)
