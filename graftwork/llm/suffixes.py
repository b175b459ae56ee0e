"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected positions are retained: positions whose
``GRAM``-word hash is the least of some ``REACH`` neighbours. Two texts that
share ``LEAST`` words share a retained suffix inside them, at most ``REACH - 1``
words from the start, and its first ``PREFIX`` words.

1. Suffixes whose first ``PREFIX`` words (by hash) stand nowhere else have no
   match; counting the hashes leaves them out.
2. The others are sorted by their own words, range partitioned, and compared
   word by word with their neighbours in that order. The longer match bounds how
   far a suffix reaches to the right; one without a match of ``PREFIX`` words goes.
3. A suffix is extended to the left and right by those alignments of ``LEAST``
   words around it that its reach allows. Each alignment belongs to one suffix,
   the leftmost least hash of its first ``REACH`` places, so it is made once.
4. Extensions are counted by a 96-bit hash (once in 1,600 times would any two of
   10^13 different ones meet); equal ones are joined to
   maximal passages per document.

The sort ends in the text and the id, so the suffixes of a passage that a third
of all documents holds spread over tasks. Neighbours in another task or batch
count as unknown, and such a suffix is extended by all its alignments: that adds
candidates and loses none. Counting folds in every task before it shuffles.
Nothing is capped: every passage of ``LEAST`` words or more that two documents
(or two places of one) share is found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import stored, table
from graftwork.llm.registry import query
from graftwork.llm.words import WordCodes, codes_of, mix, power_runs, runs

LEAST = 50
GRAM, REACH = 8, 26
PREFIX = LEAST - REACH + 1
ROWS = 2_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """Least or greatest of every ``size`` neighbours, by doubling."""
    width = 1
    out = x
    while width * 2 <= size:
        out = pick(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def retained(codes: np.ndarray) -> np.ndarray:
    """Positions of retained suffixes: least hash of some window of ``REACH`` runs."""
    hashes = runs(codes, GRAM)
    if len(hashes) < REACH:
        return np.empty(0, np.int64)
    least = _sliding(hashes, REACH, np.minimum)
    padded = np.pad(least, REACH - 1, mode="constant")
    return np.flatnonzero(_sliding(padded, REACH, np.maximum) == hashes)


def _codes(text: str | None, known: WordCodes) -> np.ndarray:
    return codes_of((text or "").encode().split(), known)


def _suffix_rows(texts: DataFrame) -> DataFrame:
    """``id, body, n_words, keys, places`` per row: text hash, and its retained suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            sizes, keys, places = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                codes = _codes(text, known)
                at = retained(codes)
                at = at[at + PREFIX <= len(codes)]
                sizes.append(len(codes))
                keys.append(power_runs(codes, PREFIX)[at].view(np.int64))
                places.append(at.astype(np.int32))
            cols = [
                batch.column("id"),
                batch.column("body"),
                pa.array(sizes, pa.int32()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(places, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "body", "n_words", "keys", "places"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, body long, n_words int, keys array<long>, places array<int>")


def alignments(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of ``LEAST`` words that belong to a suffix of ``places``, and the suffix of each; both rise.

    A start belongs to the leftmost least run hash among its first ``REACH``
    places. That depends on its own words alone, so equal extensions belong to
    suffixes at the same distance.
    """
    hashes = runs(codes, GRAM)
    n = len(codes) - LEAST + 1
    if n <= 0 or not len(places):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = _sliding(np.arange(len(hashes)), REACH, lambda a, b: np.where(hashes[a] <= hashes[b], a, b))[:n]
    kept = np.zeros(len(hashes), bool)
    kept[places] = True
    starts = np.flatnonzero(kept[owner])
    return starts, owner[starts]


def _plain(word: bytes) -> bytes:
    """A word as it is sorted: one over 64 bytes by its first 24 and a digest."""
    return word if len(word) <= 64 else word[:24] + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def _anchored(anchors: DataFrame) -> DataFrame:
    """One row per kept suffix: its first ``LEAST`` words, and the extensions that belong to it.

    Of equal extensions of a text the first counts, and those at which the text
    repeats it without overlap. ``starts`` has twice the place, one more for a repeat.
    """
    kind = anchors.schema["id"].dataType.simpleString()
    fields = "starts array<int>, one array<long>, two array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column("text")[i].as_py().encode().split()
                codes = codes_of(found, known)
                at, owner = alignments(codes, np.array(batch.column("places")[i].as_py(), np.int64))
                one = power_runs(codes, LEAST)[at].view(np.int64)
                two = (power_runs(mix(codes), LEAST)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                _, first, which = np.unique(one, return_index=True, return_inverse=True)
                again = at >= at[first][which] + LEAST
                use = again.copy()
                use[first] = True
                starts, owner, one, two = (2 * at + again)[use], owner[use], one[use], two[use]
                place, begin = np.unique(owner, return_index=True)
                ends = np.append(begin, len(owner))
                words = [_plain(w) for w in found]
                for k in range(0, len(place), ROWS):
                    part = place[k : k + ROWS]
                    lists = pa.array(ends[k : k + len(part) + 1] - ends[k], pa.int32())
                    held = slice(ends[k], ends[k + len(part)])
                    values = [pa.array(starts[held], pa.int32()), pa.array(one[held]), pa.array(two[held])]
                    cols = [
                        batch.column("id").take(pa.array(np.full(len(part), i))),
                        batch.column("body").take(pa.array(np.full(len(part), i))),
                        pa.array(part, pa.int32()),
                        pa.array([b" ".join(words[p : p + LEAST]) for p in part.tolist()], pa.binary()),
                        *[pa.ListArray.from_arrays(lists, v) for v in values],
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "body", "place", "head", "starts", "one", "two"])

    return anchors.select("id", "body", "text", "places").mapInArrow(run, f"id {kind}, body long, place int, head binary, {fields}")


def words_shared(a: bytes, b: bytes) -> int:
    """Number of first words that two space separated texts have in common."""
    if a == b:
        return a.count(b" ") + 1
    size = min(len(a), len(b))
    differ = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    if differ:
        return a.count(b" ", 0, size - (differ.bit_length() + 7) // 8)
    # The shorter one is the beginning of the longer; its last word counts if it ends there too.
    return max(a, b, key=len).count(b" ", 0, size + 1)


def _extended(suffixes: DataFrame) -> DataFrame:
    """``id, body, starts, one, two``: extensions of the sorted suffixes that their reach allows."""
    kind = suffixes.schema["id"].dataType.simpleString()
    lists = ("starts", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            heads, bodies = batch.column("head").to_pylist(), batch.column("body").to_pylist()
            places = batch.column("place").to_numpy()
            # Rows of equal texts at one place are one suffix.
            marks = list(zip(heads, bodies, places.tolist(), strict=True))
            first = [i for i in range(len(marks)) if i == 0 or marks[i] != marks[i - 1]]
            shared = np.full(len(first) + 1, LEAST)
            shared[1:-1] = [words_shared(heads[a], heads[b]) for a, b in zip(first, first[1:], strict=False)]
            if marks and before is not None and before != marks[0]:
                shared[0] = words_shared(before[0], heads[0])
            before = marks[-1] if marks else before
            reach = np.repeat(np.maximum(shared[:-1], shared[1:]), np.diff([*first, len(marks)]))
            reach[reach < PREFIX] = 0

            column = batch.column("starts")
            sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            starts = column.flatten().to_numpy(zero_copy_only=False)
            held = starts // 2 + LEAST <= places[row] + reach[row]
            left = np.bincount(row[held], minlength=batch.num_rows)
            offsets = pa.array(np.r_[0, np.cumsum(left)], pa.int32())
            mask = pa.array(held, pa.bool_())
            cut = [pa.ListArray.from_arrays(offsets, batch.column(c).flatten().filter(mask)) for c in lists]
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("body"), *cut], ["id", "body", *lists])
            yield out.filter(pa.array(left > 0, pa.bool_()))

    return suffixes.mapInArrow(run, f"id {kind}, body long, starts array<int>, one array<long>, two array<int>")


def _passages(marked: DataFrame) -> DataFrame:
    """Merge the marked extensions of each document into maximal passages.

    ``marks`` is an array of (start, length, first_id); the passage's first_id is
    the least of its parts, ``extra`` the word ranges that another text holds first.
    """
    kind = marked.schema["id"].dataType.simpleString()

    def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and stops of the unions of sorted ranges, and where each union begins among them."""
        reach = np.maximum.accumulate(stop)
        first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if len(start) else np.empty(0, np.int64)
        return start[first], np.maximum.reduceat(stop, first) if len(start) else stop, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("marks")
            ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            fields = {k: lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("start", "length", "first_id", "extra")}
            rows, starts, stops, firsts, extras = [], [], [], [], []
            for i, (begin, end) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
                order = begin + np.argsort(fields["start"][begin:end], kind="stable")
                start, extra = fields["start"][order], fields["extra"][order].astype(bool)
                stop = start + fields["length"][order]
                a, b, first = merged(start, stop)
                own_a, own_b, _ = merged(start[extra], stop[extra])
                span = np.searchsorted(a, own_a, "right") - 1
                rows += [i] * len(a)
                starts.append(a)
                stops.append(b)
                firsts += np.minimum.reduceat(fields["first_id"][order], first).tolist()
                extras += [np.column_stack([own_a[span == k], own_b[span == k]]).tolist() for k in range(len(a))]
            none = np.empty(0, np.int32)
            cols = [
                batch.column("id").take(pa.array(rows, pa.int64())),
                batch.column("body").take(pa.array(rows, pa.int64())),
                pa.array(np.concatenate([none, *starts]), pa.int32()),
                pa.array(np.concatenate([none, *stops]), pa.int32()),
                pa.array(firsts, batch.schema.field("id").type),
                pa.array(extras, pa.list_(pa.list_(pa.int32()))),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "body", "start", "stop", "first_id", "extra"])

    return marked.mapInArrow(run, f"id {kind}, body long, start int, stop int, first_id {kind}, extra array<array<int>>")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal repeated passage: ``id, start, stop, first_id, extra``.

    ``start`` and ``stop`` count white-space separated words. ``first_id`` is the
    smallest id that holds (part of) the passage. ``extra`` are the word ranges
    inside it that a row with a smaller id, or an earlier place of the row,
    holds too. Null, empty and short texts have no passages. Equal texts are
    passages as a whole. Rows without an id take no part. Rows of one id with
    different texts have passages of their own, and none of them is extra
    because of another; equal rows count as one. Other columns are ignored,
    whatever their names.
    """
    return _repeated(df, id_col, text_col).drop("body").withColumnRenamed("id", id_col)


def _repeated(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """:func:`repeated_passages` with ``body``, the hash of the row's text."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("body"))
    texts = texts.filter("id IS NOT NULL")
    rows = stored(_suffix_rows(texts), "suffixes")

    suffixes = rows.select("id", "body", F.explode(F.arrays_zip("keys", "places")).alias("s"))
    suffixes = suffixes.select("id", "body", F.col("s.keys").alias("key"), F.col("s.places").alias("place"))
    # A prefix counts when two different texts hold it, or one text in two places.
    kept = stored(
        suffixes.groupBy("key")
        .agg(F.min("body").alias("a"), F.max("body").alias("b"), F.min("place").alias("p"), F.max("place").alias("q"))
        .filter((F.col("a") != F.col("b")) | (F.col("p") != F.col("q")))
        .select("key"),
        "kept",
    )
    anchors = suffixes.join(kept, "key", "left_semi").groupBy("id", "body").agg(F.collect_list("place").alias("places"))
    anchors = stored(anchors, "anchors")
    order = ["head", "body", "place", "id"]
    array = stored(_anchored(anchors.join(texts, ["id", "body"])), "suffix-array")
    extended = stored(_extended(array.repartitionByRange(*order).sortWithinPartitions(*order)), "extended")

    windows = extended.select("id", "body", F.explode(F.arrays_zip("one", "two", "starts")).alias("w"))
    windows = windows.select(
        "id", "body", "w.one", "w.two", F.expr("w.starts div 2").cast("int").alias("start"), F.expr("w.starts % 2 = 1").alias("again")
    )
    shared = stored(
        windows.groupBy("one", "two")
        .agg(F.min("body").alias("a"), F.max("body").alias("b"), F.max("again").alias("again"), F.min("id").alias("first_id"))
        .filter("a <> b OR again")
        .select("one", "two", "first_id", (F.col("a") != F.col("b")).alias("others")),
        "shared",
    )
    mark = ["id", "body", "start", "length", "first_id", "extra"]
    held = windows.join(shared, ["one", "two"]).filter("others OR again").select(
        "id", "body", "start", F.lit(LEAST).alias("length"), "first_id", (F.col("again") | (F.col("id") != F.col("first_id"))).alias("extra")
    )
    copies = stored(rows.filter(f"n_words >= {LEAST}").groupBy("body", "n_words").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    whole = rows.select("id", "body", "n_words").join(copies, ["body", "n_words"]).select(
        "id", "body", F.lit(0).alias("start"), F.col("n_words").alias("length"), "first_id", (F.col("id") != F.col("first_id")).alias("extra")
    )
    marks = held.select(mark).unionByName(whole.select(mark))
    grouped = marks.groupBy("id", "body").agg(F.collect_list(F.struct("start", "length", "first_id", "extra")).alias("marks"))
    return _passages(grouped)


def cut_words(text: str, ranges: list[list[int]]) -> str:
    """``text`` without the word ranges, which are sorted and apart; the rest stays as it is."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, stop in ranges:
        out.append(text[at : places[start][0]])
        at = places[stop][0] if stop < len(places) else len(text)
    return "".join([*out, text[at:]])


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every repeated passage kept in one place only.

    Texts without repeats stay as they are, as do rows without an id and what
    only rows of one id share. A row whose whole text is held
    elsewhere goes; one that was empty before stays.
    """
    found = _repeated(df, id_col, text_col)
    extra = found.filter(F.size("extra") > 0).groupBy(F.col("id").alias("__id"), F.col("body").alias("__body")).agg(
        F.sort_array(F.flatten(F.collect_list("extra"))).alias("__extra")
    )
    extra = stored(extra, "extra")
    kind = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column("__extra").to_pylist()
            texts = batch.column(text_col).to_pylist()
            cut = [cut_words(t, r) if r else t for t, r in zip(texts, ranges, strict=True)]
            keep = [not r or bool(t.strip()) for t, r in zip(cut, ranges, strict=True)]
            at = batch.schema.get_field_index(text_col)
            cols = [pa.array(cut, batch.column(c).type) if c == at else batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    joined = df.join(extra, (df[id_col] == extra["__id"]) & (F.xxhash64(df[text_col]) == extra["__body"]), "left").select(*df.columns, "__extra")
    return joined.mapInArrow(run, kind)


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "start",
        "stop",
        (F.col("stop") - F.col("start")).alias("n_words"),
        F.col("first_id").alias("first_doc_id"),
        (F.size("extra") == 0).alias("kept"),
    )
