"""Texts as runs of numbered chunks, so that each distinct chunk is encoded once.

A byte-level pre-tokenizer never joins a character with white space after it,
so a text may be cut before every space between two words, and the parts can be
encoded apart. Words repeat, and a worker remembers what it has encoded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

# A space next to other white space may belong to one match with it.
TIED = re.compile(r" (?:\s|\Z)")
SLICE_CHARS = 2_000_000
REMEMBERED = 700_000
# White space that shares a match with what follows it, or ends the text.
MEETING = re.compile(r"\s(?:\s|\Z|(?<![ \n]))")
MEMORY_BYTES = 64 * 2**20
ENTRY_BYTES = 250


class _Numbers(dict):
    """Key to row number; a new key is appended to ``fresh``."""

    def __init__(self, prefix: str, fresh: list[str], first: int = 0):
        self.prefix, self.fresh = prefix, fresh

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self.fresh)
        self.fresh.append(self.prefix + key)
        return number


class Ragged:
    """Rows of integers, one after the other."""

    def __init__(self, rows: Sequence[np.ndarray] = (), dtype=np.uint32):
        self.lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.flat = np.concatenate(rows).astype(dtype) if len(rows) else np.empty(0, dtype)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def of(cls, flat: np.ndarray, lengths: np.ndarray) -> Ragged:
        made = cls()
        made.flat, made.lengths, made.starts = flat, lengths, np.cumsum(lengths) - lengths
        return made

    def extend(self, other: Ragged) -> None:
        self.starts = np.concatenate([self.starts, other.starts + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, other.lengths])
        self.flat = np.concatenate([self.flat, other.flat])

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen rows after each other, and where each of them ends."""
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[index] - (ends - lengths), lengths) + np.arange(total)
        return self.flat[at], ends


class Remembered(dict):
    """Chunk to the number of its row of ids; asking for an unknown chunk gives it the next number."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.rows, self.used, self.size = 0, 0, 0
        self.flat, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def __missing__(self, key: str) -> int:
        number = self[key] = self.rows + len(self.fresh)
        self.fresh.append(key)
        return number

    def learn(self, found: Ragged) -> None:
        """Ids of the fresh chunks, behind what is known; the arrays grow by doubling."""
        while self.used + len(found.flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while self.rows + len(self.fresh) >= len(self.ends):
            self.ends = np.resize(self.ends, 2 * len(self.ends))
        self.flat[self.used : self.used + len(found.flat)] = found.flat
        self.ends[self.rows + 1 : self.rows + 1 + len(self.fresh)] = self.used + np.cumsum(found.lengths)
        self.size += ENTRY_BYTES * len(self.fresh) + sum(map(len, self.fresh)) + 4 * len(found.flat)
        self.used += len(found.flat)
        self.rows += len(self.fresh)
        self.fresh = []

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen rows after each other, and where each of them ends."""
        starts = self.ends[index]
        lengths = self.ends[index + 1] - starts
        ends = np.cumsum(lengths)
        at = np.repeat(starts - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.flat[at], ends


class TextEncoder:
    """Token ids of texts through ``encode``, which takes distinct chunks.

    Texts are cut before single spaces and around single line feeds; ``pieces``
    cuts those in which white space meets white space or the end. What is
    remembered is forgotten when it takes ``most`` bytes; this bounds memory and
    does not change any result.
    """

    def __init__(self, encode: Callable[[list[str]], Ragged], pieces: Callable[[str], list[str]], most: int = MEMORY_BYTES):
        self.encode, self.pieces, self.most = encode, pieces, most
        self.known = Remembered()

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        known = self.known
        if known.size > self.most:
            known.forget()
        number, numbers, counts = known.__getitem__, [], []
        for text in texts:
            before = len(numbers)
            if MEETING.search(text):
                numbers.extend(map(number, self.pieces(text)))
            elif text:
                for k, line in enumerate(text.split("\n")):
                    if k:
                        numbers.append(number("\n"))
                    first, *rest = line.split(" ")
                    if first:
                        numbers.append(number(first))
                    numbers.extend([number(" " + word) for word in rest])
            counts.append(len(numbers) - before)
        if known.fresh:
            known.learn(self.encode(known.fresh))
        ids, ends = known.take(np.array(numbers, np.int64))
        bounds = np.concatenate([[0], ends])[np.cumsum(counts)] if counts else []
        return np.split(ids, bounds[:-1]) if counts else []


class ChunkEncoder:
    """Token ids of texts through ``encode``, which takes distinct chunks.

    ``pieces`` cuts a text whose spaces are tied to other white space. What is
    remembered is forgotten when it holds ``REMEMBERED`` chunks; this bounds
    memory and does not change any result.
    """

    def __init__(self, encode: Callable[[list[str]], Ragged], pieces: Callable[[str], list[str]]):
        self.encode, self.pieces = encode, pieces
        self._forget()

    def _forget(self) -> None:
        self.fresh: list[str] = []
        self.plain, self.spaced = _Numbers("", self.fresh), _Numbers(" ", self.fresh)
        self.known = Ragged()

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        if len(self.fresh) > REMEMBERED:
            self._forget()
        plain, spaced, numbers, counts = self.plain.__getitem__, self.spaced.__getitem__, [], []
        for text in texts:
            before = len(numbers)
            if TIED.search(text):
                numbers.extend(map(plain, self.pieces(text)))
            elif text:
                first, *rest = text.split(" ")
                numbers.append(plain(first))
                numbers.extend(map(spaced, rest))
            counts.append(len(numbers) - before)
        done = len(self.known.lengths)
        if done < len(self.fresh):
            self.known.extend(self.encode(self.fresh[done:]))
        ids, ends = self.known.take(np.array(numbers, np.int64))
        last = np.cumsum(counts)
        bounds = np.concatenate([[0], ends])[last] if len(counts) else []
        return np.split(ids, bounds[:-1]) if len(counts) else []


def sliced(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch so that each part holds a bounded amount of text, or one row."""
    sizes = pa.compute.fill_null(pa.compute.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            part = batch.slice(a, b - a)
            yield part, [x or "" for x in part.column(text).to_pylist()]
