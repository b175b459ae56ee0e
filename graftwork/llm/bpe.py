"""Byte-level BPE by rank files: encoding and decoding in padded numpy matrices.

Distinct pieces of a worker's texts are put into matrices of rows of similar
length. In every round each row merges its leftmost pair of lowest rank; pair
ranks come from a hash table, finished rows leave the matrix. The vocabulary is
fixed in size and is broadcast.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.chunks import ChunkEncoder, Ragged, sliced
from graftwork.llm.common import table
from graftwork.llm.registry import query

NO_PAIR = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MATRIX_CELLS = 1 << 22
WORD_CELLS = 1 << 17


@dataclass
class Vocabulary:
    """Token bytes by rank, and a hash table from pairs of ranks to the merged rank."""

    tokens: list[bytes]
    slots: np.ndarray
    merged: np.ndarray
    bits: int

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        return cls(tokens, *_hashed(np.array(left), np.array(right), np.array(merged)))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), NO_PAIR)
        todo, at = np.arange(len(keys)), _slot(keys, self.bits)
        while len(todo):
            found = self.slots[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.merged[at[hit]]
            on = ~hit & (found != EMPTY)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


def _hashed(left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots, values and size in bits of a table from pairs to what they merge to."""
    keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
    bits = max(4, int(len(keys) * 3).bit_length())
    slots, values = np.full(1 << bits, EMPTY), np.full(1 << bits, NO_PAIR)
    todo, at = np.arange(len(keys)), _slot(keys, bits)
    while len(todo):
        free = slots[at] == EMPTY
        slots[at[free]] = keys[todo[free]]  # the last writer of a slot stays in it
        put = slots[at] == keys[todo]
        values[at[put]] = merged.astype(np.int32)[todo[put]]
        todo, at = todo[~put], (at[~put] + 1) & ((1 << bits) - 1)
    return slots, values, bits


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)


class PieceEncoder:
    """Ids of pre-tokenizer matches."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v = vocabulary
        self.whole = {token: rank for rank, token in enumerate(vocabulary.tokens) if token}
        self.bytes = np.zeros(256, np.int32)
        for value in range(256):
            self.bytes[value] = self.whole[bytes([value])]
        self.find = regex.compile(pattern).findall

    def chunks(self, chunks: list[str]) -> Ragged:
        """Ids of chunks: the ids of their pieces after each other."""
        numbers: dict[str, int] = {}
        index, counts = [], []
        for chunk in chunks:
            pieces = self.find(chunk)
            counts.append(len(pieces))
            index.extend([numbers.setdefault(p, len(numbers)) for p in pieces])
        rows = Ragged(self.pieces([p.encode() for p in numbers]))
        out = Ragged()
        out.flat, ends = rows.take(np.array(index, np.int64))
        stops = np.concatenate([[0], ends])[np.cumsum(counts)]
        out.lengths = np.diff(stops, prepend=0)
        out.starts = stops - out.lengths
        return out

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.whole.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.int32)
            elif piece:
                by_width.setdefault(_width(len(piece)), []).append(i)
        for width, rows in by_width.items():
            step = max(1, MATRIX_CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        inside = np.arange(width) < lengths[:, None]
        tokens = np.zeros((len(pieces), width), np.int32)
        tokens[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), NO_PAIR)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.v.pair_ranks(tokens[:, :-1][pair], tokens[:, 1:][pair])
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(rows):
            at = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(rows)), at]
            over = lowest == NO_PAIR
            if over.any():
                for k in np.flatnonzero(over):
                    out[rows[k]] = tokens[k, : lengths[k]].copy()
                on = ~over
                rows, tokens, ranks, lengths = rows[on], tokens[on], ranks[on], lengths[on]
                at, lowest = at[on], lowest[on]
                if not len(rows):
                    break
                longest = int(lengths.max())
                tokens, ranks = tokens[:, :longest], ranks[:, :longest]
            each, columns = np.arange(len(rows)), np.arange(tokens.shape[1])
            # Drop the right part of the merged pair: all after it move left by one.
            source = np.minimum(columns + (columns > at[:, None]), tokens.shape[1] - 1)
            tokens, ranks = np.take_along_axis(tokens, source, 1), np.take_along_axis(ranks, source, 1)
            lengths = lengths - 1
            tokens[each, at] = lowest
            ranks[each, lengths - 1] = NO_PAIR
            for start in (at - 1, at):
                k = np.flatnonzero((start >= 0) & (start + 1 < lengths))
                ranks[k, start[k]] = self.v.pair_ranks(tokens[k, start[k]], tokens[k, start[k] + 1])
        return out


class WordMerger:
    """Ids of short byte strings by merges in the order of their ids, many words at a time.

    ``of_file`` reads a tokenizer file with a byte-level vocabulary whose later
    merges have larger ids; for any other file it gives nothing.
    """

    def __init__(self, vocabulary: Vocabulary, first: np.ndarray):
        self.v, self.first = vocabulary, first

    @classmethod
    def of_file(cls, text: str) -> WordMerger | None:
        model = json.loads(text)["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        if any(model.get(c) for c in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix")):
            return None
        vocab = model["vocab"]
        # The usual letters for bytes: themselves where printable, else the next code points from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        letters = [chr(x if x in shown else next(hidden)) for x in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = np.array([vocab["".join(p)] for p in pairs])
        if not all(x in vocab for x in letters) or (np.diff(merged) <= 0).any():
            return None
        left, right = (np.array([vocab[p[k]] for p in pairs]) for k in (0, 1))
        return cls(Vocabulary([], *_hashed(left, right, merged)), np.array([vocab[x] for x in letters], np.int32))

    def __call__(self, words: list[bytes]) -> Ragged:
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        data = self.first[np.frombuffer(b"".join(words), np.uint8)]
        order = np.argsort(size, kind="stable")
        place, found, lengths, k = [], [], [], 0
        while k < len(order):
            # Words of similar length, in a matrix that stays in the cache.
            width = max(2, int(size[order[k]] * 5 // 4))
            stop = min(int(np.searchsorted(size[order], width, "right")), k + max(1, WORD_CELLS // width))
            own = order[k : stop]
            for rows, tokens, n in self._merge(data, start[own], size[own]):
                place.append(own[rows])
                found.append(tokens)
                lengths.append(n)
            k = stop
        if not place:
            return Ragged()
        rows = Ragged.of(np.concatenate(found).astype(np.uint32), np.concatenate(lengths))
        back = np.empty(len(words), np.int64)
        back[np.concatenate(place)] = np.arange(len(words))
        flat, ends = rows.take(back)
        return Ragged.of(flat, np.diff(ends, prepend=0))

    def _merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(rows, their ids after each other, how many), as rows are done."""
        width = max(1, int(length.max()))
        columns = np.arange(width)
        inside = columns < length[:, None]
        tokens = np.zeros((len(start), width), np.int32)
        tokens[inside] = data[(start[:, None] + columns)[inside]]
        ranks = np.full((len(start), width), NO_PAIR)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.v.pair_ranks(tokens[:, :-1][pair], tokens[:, 1:][pair])
        rows = np.arange(len(start))
        while len(rows):
            at = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(rows)), at]
            over = lowest == NO_PAIR
            if over.any():
                yield rows[over], tokens[over][columns < length[over][:, None]], length[over]
                on = ~over
                rows, at, lowest, length = rows[on], at[on], lowest[on], length[on]
                if not len(rows):
                    return
                width = int(length.max())
                columns = np.arange(width)
                tokens, ranks = tokens[on, :width], ranks[on, :width]
            each = np.arange(len(rows))
            # Drop the right part of the merged pair: all after it move left by one.
            later = columns[:-1] > at[:, None]
            np.copyto(tokens[:, :-1], tokens[:, 1:].copy(), where=later)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=later)
            length = length - 1
            tokens[each, at] = lowest
            ranks[each, length - 1] = NO_PAIR
            for left in (at - 1, at):
                k = np.flatnonzero((left >= 0) & (left + 1 < length))
                ranks[k, left[k]] = self.v.pair_ranks(tokens[k, left[k]], tokens[k, left[k] + 1])


def _width(length: int) -> int:
    """Lengths share a matrix up to the next of 4, 6, 8, 12, 16, 24, ..."""
    power = 1 << max(2, (length - 1).bit_length())
    return power * 3 // 4 if length <= power * 3 // 4 else power


def encode(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, ids``: the token ids of every text as little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded apart, without special tokens. Null
    and empty texts have no ids. Rows are kept as they are, repeated ones too;
    other columns are ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.read(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceEncoder(vocabulary.value, pattern)
        encoder = ChunkEncoder(pieces.chunks, pieces.find)
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                ids = [x.astype("<u4").tobytes() for x in encoder(texts)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, bytes``: the bytes of every row of ids; null ids are no bytes."""
    spark = df.sparkSession
    tokens = spark.sparkContext.broadcast(Vocabulary.read(ranks_path).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [
                    b"".join(map(known.__getitem__, np.frombuffer(x or b"", "<u4").tolist()))
                    for x in part.column("ids").to_pylist()
                ]
                keep = [part.column(0), part.column(1), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(keep, ["id", "ids", "bytes"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return (
        rows.mapInArrow(run, f"id {kind}, ids binary, bytes binary")
        .withColumnsRenamed({"id": id_col, "ids": ids_col})
    )


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(coded, ranks).select(
        "doc_id",
        F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
