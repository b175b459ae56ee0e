"""Vectorised work on parameter blocks, run inside Arrow batches.

Spark filters, shuffles, joins and sorts the block rows; the functions here
only walk the sorted rows of one task and hold one block of state at a time.
Higher-order SQL functions would visit every value through an interpreted
lambda, about ten times slower on blocks of 65,536 floats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

FLUSH_BYTES = 16 * 2**20
BASE_ORD = -1
WEIGHT_EPS = 1e-8
FLOATS = pa.list_(pa.float32())
MERGED = pa.schema(
    [("target", pa.string()), ("tensor", pa.string()), ("block_no", pa.int64()), ("values_", FLOATS)]
)

Batches = Iterator[pa.RecordBatch]


def rows_of(batches: Batches, values: str = "values_") -> Iterator[dict]:
    """Rows as dicts; the list column comes as a numpy view."""
    for batch in batches:
        lists = batch.column(values)
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        others = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != values}
        for i in range(batch.num_rows):
            row = {n: c[i] for n, c in others.items()}
            row[values] = flat[ends[i] : ends[i + 1]]
            yield row


def groups_of(rows: Iterator[dict], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of equal keys in sorted rows, without collecting a run."""
    row = next(rows, None)
    while row is not None:
        key = tuple(row[k] for k in keys)

        def run(key=key) -> Iterator[dict]:
            nonlocal row
            while row is not None and tuple(row[k] for k in keys) == key:
                yield row
                row = next(rows, None)

        members = run()
        yield key, members
        for _ in members:
            pass


class Emitter:
    """Collect output rows and hand them over in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += sum(v.nbytes for v in row if isinstance(v, np.ndarray)) + 64
        if self.size >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows, strict=True))
            arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
            self.rows, self.size = [], 0


# --- magnitudes ------------------------------------------------------------------
def magnitude_bits(delta: np.ndarray) -> np.ndarray:
    """Bit pattern of |delta|; orders single-precision magnitudes exactly."""
    return np.abs(delta.astype(np.float32)).view(np.uint32).astype(np.int64)


def count_values(keys: tuple[str, ...], pick: Callable[[dict, np.ndarray], np.ndarray], schema: pa.Schema):
    """Per run of ``keys``: how often each picked integer occurs.

    ``pick`` returns integers below 2**16, so the counters have a fixed size.
    """

    def run(batches: Batches) -> Batches:
        out = Emitter(schema)
        for key, rows in groups_of(rows_of(batches, "delta"), keys):
            counts = np.zeros(2**16, dtype=np.int64)
            waiting, size = [], 0
            for row in rows:
                waiting.append(pick(row, magnitude_bits(row["delta"])))
                size += len(waiting[-1])
                if size >= 2**16:
                    counts += np.bincount(np.concatenate(waiting), minlength=2**16)
                    waiting, size = [], 0
            if size:
                counts += np.bincount(np.concatenate(waiting), minlength=2**16)
            for value in np.flatnonzero(counts):
                yield from out.add(*key, int(value), int(counts[value]))
        yield from out.flush()

    return run


def high_bits(row: dict, bits: np.ndarray) -> np.ndarray:
    return bits >> 16


def low_bits_in_bucket(row: dict, bits: np.ndarray) -> np.ndarray:
    return bits[(bits >> 16) == row["bucket"]] & 0xFFFF


def count_ties(schema: pa.Schema):
    """Number of values per block whose magnitude is exactly the cut."""

    def run(batches: Batches) -> Batches:
        out = Emitter(schema)
        for row in rows_of(batches, "delta"):
            n = int((magnitude_bits(row["delta"]) == row["mag"]).sum())
            if n:
                yield from out.add(
                    row["model"], row["tensor"], row["density"], row["mag"], row["wanted"], row["block_no"], n
                )
        yield from out.flush()

    return run


def keep_largest(row: dict, delta: np.ndarray) -> np.ndarray:
    """Zero what lies below the cut; ties stay up to the row's tie position."""
    if row["mag"] is None:
        return delta if row["density"] >= 1 else np.zeros_like(delta)
    bits = magnitude_bits(delta)
    keep = bits > row["mag"]
    ties = np.flatnonzero(bits == row["mag"])
    if row["block_no"] < row["tie_block"]:
        keep[ties] = True
    elif row["block_no"] == row["tie_block"]:
        keep[ties[: row["tie_left"]]] = True
    return np.where(keep, delta, np.float32(0))


def keep_all(row: dict, delta: np.ndarray) -> np.ndarray:
    return delta


def trim_rows(schema: pa.Schema):
    def run(batches: Batches) -> Batches:
        out = Emitter(schema)
        for row in rows_of(batches, "delta"):
            kept = keep_largest(row, row["delta"].astype(np.float32))
            yield from out.add(row["model"], row["tensor"], row["density"], row["block_no"], kept)
        yield from out.flush()

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """Public 32-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(2246822507)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(3266489909)
    return x ^ (x >> np.uint32(16))


def uniform_draws(prefix: str, n: int) -> np.ndarray:
    """``n`` 32-bit draws that depend on nothing but the prefix and the place."""
    key = int.from_bytes(hashlib.md5(prefix.encode()).digest()[:4], "big")
    steps = np.arange(n, dtype=np.uint64) * np.uint64(2654435769) + np.uint64(key)
    return _mixed((steps & np.uint64(0xFFFFFFFF)).astype(np.uint32))


def drop_at_random(row: dict, delta: np.ndarray, seed: int) -> np.ndarray:
    """Keep each value with probability ``density``, divided by ``density``.

    The draw comes from (seed, model, tensor, block) and the position, so it is
    the same for every partitioning and retry.
    """
    density = row["density"]
    wide = delta.astype(np.float64)
    if density >= 1:
        return wide
    draws = uniform_draws(f"{seed}|{row['model']}|{row['tensor']}|{row['block_no']}", len(delta))
    return np.where(draws < np.uint64(np.floor(density * 2.0**32)), wide / density, 0.0)


def random_dropper(seed: int) -> Callable[[dict, np.ndarray], np.ndarray]:
    return lambda row, delta: drop_at_random(row, delta, seed)


# --- folds over the models of one target block ------------------------------------------
def _float32(values: np.ndarray) -> np.ndarray:
    # Adding zero turns a negative zero into a plain one.
    return values.astype(np.float32) + np.float32(0)


def _fold(block: Callable[[Iterator[dict]], np.ndarray | None]):
    """Stream function: one output block per (target, tensor, block_no) run."""

    def run(batches: Batches) -> Batches:
        out = Emitter(MERGED)
        for key, rows in groups_of(rows_of(batches), ("target", "tensor", "block_no")):
            merged = block(rows)
            if merged is not None:
                yield from out.add(*key, _float32(merged))
        yield from out.flush()

    return run


def average_stream(partial: bool = False):
    """Plain mean; the first model decides which blocks exist, or with ``partial`` all models."""

    def block(rows: Iterator[dict]) -> np.ndarray | None:
        first = next(rows)
        if first["ord"] != 0 and not partial:
            return None
        total, n = first["values_"].astype(np.float64), 1
        for row in rows:
            total += row["values_"]
            n += 1
        if n > first["k"] or (n < first["k"] and not partial):
            raise ValueError(f"an adapter {'repeats' if n > first['k'] else 'lacks'} block {first['block_no']} of {first['tensor']}")
        return total / n

    return _fold(block)


def _check_complete(row: dict, n: int, partial: bool) -> None:
    if n > row["k"]:
        raise ValueError(f"a model repeats block {row['block_no']} of {row['tensor']}")
    if n < row["k"] and not partial:
        raise ValueError(f"{row['k'] - n} of {row['k']} models lack block {row['block_no']} of {row['tensor']}")


def linear_stream(normalize: bool, partial: bool = False):
    def block(rows: Iterator[dict]) -> np.ndarray:
        total, weights, n = 0.0, 0.0, 0
        for row in rows:
            n += 1
            total = total + row["values_"].astype(np.float64) * row["weight"]
            weights += row["weight"]
        _check_complete(row, n, partial)
        return total / weights if normalize and abs(weights) >= WEIGHT_EPS else total

    return _fold(block)


def sign_election_stream(normalize: bool, sparsify: Callable[[dict, np.ndarray], np.ndarray], partial: bool = False):
    """Elect a sign per value, average the agreeing side, add it to the base.

    Both sides are summed apart with their weights, so one pass over the models
    is enough: the heavier side wins. With ``partial`` a block that the base
    lacks is left out.
    """

    def block(rows: Iterator[dict]) -> np.ndarray | None:
        base = next(rows)
        if base["ord"] != BASE_ORD:
            if partial:
                return None
            raise ValueError(f"the base lacks block {base['block_no']} of {base['tensor']}")
        theta = base["values_"].astype(np.float64)
        up, down, up_w, down_w = (np.zeros_like(theta) for _ in range(4))
        n = 0
        for row in rows:
            n += 1
            delta = (row["values_"].astype(np.float64) - theta).astype(np.float32)
            moved = sparsify(row, delta).astype(np.float64)
            w = row["weight"]
            up += np.where(moved > 0, moved * w, 0.0)
            down += np.where(moved < 0, moved * w, 0.0)
            up_w += np.where(moved > 0, w, 0.0)
            down_w += np.where(moved < 0, w, 0.0)
        if not n:  # a block of the base that no model has is not merged
            return None
        _check_complete(base, n, partial)
        sign = up + down
        side = np.where(sign > 0, up, np.where(sign < 0, down, 0.0))
        weight = np.where(sign > 0, up_w, np.where(sign < 0, down_w, 0.0))
        if normalize:
            side = side / np.where(np.abs(weight) < WEIGHT_EPS, 1.0, weight)
        return theta + side

    return _fold(block)
