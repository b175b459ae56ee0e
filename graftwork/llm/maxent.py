"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | before) = P(class | before) * P(word | class). Classes group words by
their endings: endings are hashed to ``ENDINGS`` groups, and those are clustered
by the groups that stand next to them. P(class | before) is a maximum-entropy
model over hashed features of the words before: the last word, the word before
it (a skip feature), the pair of their classes, and their endings. P(word |
class) comes from counts with absolute discounting; what the discount frees in
a class is the probability of its unknown words.

* Texts are tokenized once into blocks of bounded size, one row each with its
  own vocabulary. A word's counts meet by its hash, and each block gets back the
  counts that differ from its own; no count table is broadcast.
* The model has a fixed number of weights. In every round each task adds up
  observed and expected feature counts of its blocks; tables are summed by shard,
  and the weights are updated. Rounds use disjoint blocks, together all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftwork.llm.common import stored, table
from graftwork.llm.registry import query
from graftwork.llm.words import BASE, WordCodes, mix, words

ENDINGS = 512
CLASSES = 32
END_CLASS = CLASSES - 1
LAST, SKIP = 8192, 4096
ROUNDS = 4
STEP = 1.5
PRIOR = 1.0
DISCOUNT = 0.5
ADDED = 0.1
SHARDS = 64
BLOCK_CHARS = 6_000_000
BATCH_TOKENS = 32_768
SHORT = 8
REMEMBERED = 500_000

# Offsets of the feature groups in the weight table; row 0 is the constant feature.
PAIR = 1
NEAR_END = PAIR + (CLASSES + 1) * (CLASSES + 1)
FAR_END = NEAR_END + ENDINGS + 1
LAST_AT = FAR_END + ENDINGS + 1
SKIP_AT = LAST_AT + LAST + 1
WEIGHT_ROWS = SKIP_AT + SKIP + 1
ACTIVE = 6
# Rows of each group of features, in the order of :func:`features`.
GROUPS = ((PAIR, NEAR_END), (NEAR_END, FAR_END), (FAR_END, LAST_AT), (LAST_AT, SKIP_AT), (SKIP_AT, WEIGHT_ROWS))

END_CODE = np.uint64(1)
PLACE_BITS = 24
BLOCK_BITS = 16


def ending(tail: str) -> int:
    """Group of the last letters of a word."""
    number = int.from_bytes(tail.encode(), "little") % (1 << 63)
    return int(mix(np.array([number], np.uint64) * BASE)[0] % np.uint64(ENDINGS))


class Lexemes(dict):
    """Word to its place in the arrays ``code`` and ``ending``."""

    def __init__(self):
        self.tails: dict[str, int] = {}
        self.hash = WordCodes()
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.code, self.ending = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.fresh: list[tuple[int, int]] = []

    def __missing__(self, word: bytes) -> int:
        tail = word.decode("utf-8", "ignore").rstrip(".,;:!?")[-3:]
        group = self.tails.get(tail)
        if group is None:
            group = self.tails[tail] = ending(tail)
        place = self[word] = len(self)
        self.fresh.append((self.hash.__missing__(word), group))
        return place

    def find(self, found: list[bytes]) -> np.ndarray:
        """Places of words; what is remembered is dropped before it grows too large."""
        if len(self) > REMEMBERED:
            self._forget()
        places = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.fresh:
            codes, groups = zip(*self.fresh, strict=True)
            self.code = np.concatenate([self.code, np.array(codes, np.uint64)])
            self.ending = np.concatenate([self.ending, np.array(groups, np.int32)])
            self.fresh = []
            self.hash.clear()
        return places


@dataclass
class Texts:
    """Tokens of several texts after each other, each text with its end."""

    code: np.ndarray
    ending: np.ndarray
    start: np.ndarray  # position of each text's first token
    length: np.ndarray

    @classmethod
    def of(cls, texts: list[str], known: Lexemes) -> Texts:
        split = [words(t) for t in texts]
        length = np.fromiter(map(len, split), np.int64, len(split)) + 1
        start = np.cumsum(length) - length
        total = int(length.sum())
        code, group = np.full(total, END_CODE), np.full(total, ENDINGS, np.int32)
        inside = np.ones(total, bool)
        inside[start + length - 1] = False
        places = known.find([w for own in split for w in own])
        code[inside], group[inside] = known.code[places], known.ending[places]
        return cls(code, group, start, length)

    def before(self, values: np.ndarray, steps: int, nothing: int) -> np.ndarray:
        """For every token the value ``steps`` tokens before it in its text."""
        out = np.full(len(values), nothing, np.int64)
        out[steps:] = values[:-steps]
        for k in range(steps):
            at = self.start + k
            out[at[k < self.length]] = nothing
        return out


def features(t: Texts, classes: np.ndarray) -> np.ndarray:
    """(features, tokens) rows of the weight table active for each token, besides the constant one."""
    cls = classes[t.ending]
    near, far = t.before(cls, 1, CLASSES), t.before(cls, 2, CLASSES)
    last = t.before((mix(t.code * BASE) % np.uint64(LAST)).astype(np.int64), 1, LAST)
    skip = t.before((mix(t.code ^ BASE) % np.uint64(SKIP)).astype(np.int64), 2, SKIP)
    return np.stack(
        [
            PAIR + near * (CLASSES + 1) + far,
            NEAR_END + t.before(t.ending, 1, ENDINGS),
            FAR_END + t.before(t.ending, 2, ENDINGS),
            LAST_AT + last,
            SKIP_AT + skip,
        ]
    ).astype(np.uint16)


def log_classes(active: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(tokens, classes) log probabilities of the next class."""
    logit = weights.take(active[0], axis=0)
    logit += weights[0]
    for row in active[1:]:
        logit += weights.take(row, axis=0)
    logit -= logit.max(axis=1, keepdims=True)
    logit -= np.log(np.exp(logit).sum(axis=1, keepdims=True))
    return logit


def _segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` from each of ``first`` to the next one.

    Long segments are products with ones; short ones are added place by place,
    all those that have a row there at once.
    """
    size = np.diff(first, append=len(values))
    sums = np.empty((len(first), values.shape[1]), values.dtype)
    ones = np.ones(size.max(initial=0), values.dtype)
    for k in np.flatnonzero(size > SHORT):
        sums[k] = ones[: size[k]] @ values[first[k] : first[k] + size[k]]
    short = np.flatnonzero(size <= SHORT)
    short = short[np.argsort(-size[short], kind="stable")]
    left, at = size[short], first[short]
    total = values.take(at, axis=0)
    for k in range(1, int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -k, side="left"))
        total[:n] += values.take(at[:n] + k, axis=0)
    sums[short] = total
    return sums


def _add_rows(rows: np.ndarray, values: np.ndarray, expected: np.ndarray) -> None:
    """Add every one of ``values`` to its row."""
    order = np.argsort(rows, kind="stable")  # a radix sort for 16-bit numbers
    ordered = rows[order]
    first = np.flatnonzero(np.diff(ordered.astype(np.int32), prepend=-1))
    expected[ordered[first]] += _segment_sums(values.take(order, axis=0), first)


def _add_expected(part: np.ndarray, chance: np.ndarray, expected: np.ndarray) -> None:
    """Add the chances of every token's classes to the rows of its features.

    A word and its ending go together, so the chances are first summed by both.
    """
    pair, near_end, far_end, last, skip = part
    _add_rows(pair, chance, expected)
    for word, tail in ((last, near_end), (skip, far_end)):
        order = np.argsort(tail, kind="stable")
        order = order[np.argsort(word[order], kind="stable")]
        both = word[order].astype(np.int64) << 16 | tail[order]
        first = np.flatnonzero(np.diff(both, prepend=-1))
        sums = _segment_sums(chance.take(order, axis=0), first)
        for feature in (word, tail):
            _add_rows(feature[order[first]], sums, expected)


def gradient(t: Texts, classes: np.ndarray, weights: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> float:
    """Add observed and expected counts of every feature and class; gives the log loss."""
    active, target, loss = features(t, classes), classes[t.ending].astype(np.int64), 0.0
    for k in range(0, len(target), BATCH_TOKENS):
        part, own = active[:, k : k + BATCH_TOKENS], target[k : k + BATCH_TOKENS]
        logs = log_classes(part, weights)
        loss -= float(logs[np.arange(len(own)), own].sum())
        chance = np.exp(logs, out=logs)
        expected[0] += chance.sum(axis=0)
        observed[0] += np.bincount(own, minlength=CLASSES)
        _add_expected(part, chance, expected)
        for row, (low, high) in zip(part, GROUPS, strict=True):
            cells = np.bincount((row.astype(np.int64) - low) * CLASSES + own, minlength=(high - low) * CLASSES)
            observed[low:high] += cells.reshape(high - low, CLASSES)
    return loss


# ---------------------------------------------------------------- blocks


def _held_out():
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with their first bytes together, then their second ones, ...: mostly zeros at the end."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


BLOCK_FIELDS = (
    "block long, ids array<{id}>, train array<boolean>, lengths array<int>, tokens binary, "
    "codes array<long>, endings array<int>, counts array<int>, cells array<int>, pairs array<long>"
)


def tokenized(texts: DataFrame) -> DataFrame:
    """One row per block of ``id, text, train`` rows, and one per task with its bigrams of endings.

    ``tokens`` are places in the block's vocabulary (``codes``, ``endings``, and
    ``counts`` in the block's training rows), most frequent first.
    """
    from pyspark import TaskContext

    fields = BLOCK_FIELDS.format(id=texts.schema["id"].dataType.simpleString())
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << BLOCK_BITS
        known, seen = Lexemes(), np.zeros((ENDINGS + 1) ** 2, np.int64)
        block, size, ids, trains, texts = 0, 0, [], [], []
        id_kind = pa.int64()

        def row(**columns) -> pa.RecordBatch:
            kinds = [
                pa.int64(), pa.list_(id_kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(),
                pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([columns.get(c)], t) for c, t in zip(names, kinds, strict=True)], names
            )

        def flush() -> pa.RecordBatch:
            t = Texts.of(texts, known)
            codes, first, place, often = np.unique(t.code, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = rank[place]
            learn = np.repeat(np.array(trains, bool), t.length)
            nonlocal seen
            seen += np.bincount(
                (t.before(t.ending, 1, ENDINGS) * (ENDINGS + 1) + t.ending)[learn], minlength=len(seen)
            )
            return row(
                block=part + block, ids=ids, train=trains, lengths=t.length.astype(np.int32), tokens=_planes(place),
                codes=codes[order].view(np.int64), endings=t.ending[first[order]],
                counts=np.bincount(place[learn], minlength=len(codes)).astype(np.int32),
            )

        for batch in batches:
            id_kind = batch.column("id").type
            for key, text, train in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "train")), strict=True):
                ids.append(key)
                trains.append(train)
                texts.append(text or "")
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield flush()
                    block, size, ids, trains, texts = block + 1, 0, [], [], []
        if ids:
            yield flush()
        cells = np.flatnonzero(seen)
        yield row(cells=cells.astype(np.int32), pairs=seen[cells])

    return stored(texts.mapInArrow(run, fields), "tokens")


def _batches_of(block: dict, classes: np.ndarray, only_training: bool) -> Iterator[tuple[Texts, np.ndarray, slice]]:
    """A block's texts in batches: tokens, their places in the vocabulary, and which texts."""
    place, length = _from_planes(block["tokens"]), np.asarray(block["lengths"], np.int64)
    code, group = np.asarray(block["codes"]).view(np.uint64), np.asarray(block["endings"], np.int32)
    if only_training:
        learn = np.asarray(block["train"], bool)
        place, length = place[np.repeat(learn, length)], length[learn]
    ends = np.cumsum(length)
    at = 0
    while at < len(length):
        begin = int(ends[at] - length[at])
        stop = max(at + 1, int(np.searchsorted(ends, begin + 2 * BATCH_TOKENS)))
        own = place[begin : int(ends[stop - 1])]
        size = length[at:stop]
        yield Texts(code[own], group[own], np.cumsum(size) - size, size), own, slice(at, stop)
        at = stop


def _blocks(batch: pa.RecordBatch, columns: list[str]) -> Iterator[dict]:
    for i in range(batch.num_rows):
        out = {}
        for c in columns:
            value = batch.column(c)[i]
            out[c] = value.as_py() if c == "tokens" else value.values.to_numpy(zero_copy_only=False)
        yield out


def cluster_endings(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class of every ending by what stands beside it; the end of a text has its own.

    Square roots of neighbour shares on both sides, their leading directions,
    then weighted k-means from a fixed start.
    """
    pairs = np.zeros((ENDINGS + 1, ENDINGS + 1))
    np.add.at(pairs.ravel(), cells, n)
    weight = pairs.sum(0)[:ENDINGS]
    sides = [pairs.T[:ENDINGS], pairs[:ENDINGS]]
    profile = np.hstack([np.sqrt((s + 1e-3) / (s.sum(1, keepdims=True) + 1e-3 * s.shape[1])) for s in sides])
    mean = np.average(profile, axis=0, weights=weight + 1e-9)
    u, s, _ = np.linalg.svd((profile - mean) * np.sqrt(weight + 1e-9)[:, None], full_matrices=False)
    points = (u * s)[:, :16] / np.sqrt(weight + 1e-9)[:, None]
    many = CLASSES - 1
    centres = points[np.argsort(-weight, kind="stable")[:many]].copy()
    group = np.zeros(ENDINGS, np.int64)
    for _ in range(40):
        far = ((points[:, None] - centres) ** 2).sum(2)
        group = far.argmin(1)
        for k in range(many):
            own = group == k
            if (weight[own] > 0).any():
                centres[k] = np.average(points[own], axis=0, weights=weight[own] + 1e-9)
    return np.append(group, END_CLASS).astype(np.int32)


# ---------------------------------------------------------------- training


def _summed(blocks: DataFrame, classes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed and expected feature counts of the training rows of ``blocks``.

    A task's table is cut into shards; a shard is summed as a stream, with one
    table of its size in memory. The sums have the fixed size of the model.
    """
    model = blocks.sparkSession.sparkContext.broadcast((classes, weights))
    size = -(-WEIGHT_ROWS // SHARDS)
    columns = ["train", "lengths", "tokens", "codes", "endings"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        observed, expected = np.zeros((WEIGHT_ROWS, CLASSES), np.int64), np.zeros((WEIGHT_ROWS, CLASSES), np.float32)
        some = False
        for batch in batches:
            for block in _blocks(batch, columns):
                for t, _, _ in _batches_of(block, model.value[0], only_training=True):
                    gradient(t, *model.value, observed, expected)
                    some = True
        if some:
            sums = np.zeros((2, size * SHARDS, CLASSES), np.float32)
            sums[0, :WEIGHT_ROWS], sums[1, :WEIGHT_ROWS] = observed, expected
            parts = [sums[:, k * size : (k + 1) * size].tobytes() for k in range(SHARDS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int32()), pa.array(parts, pa.binary())], ["shard", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("sums"), strict=True):
                more = np.frombuffer(data.as_buffer(), np.float32)
                sums[shard] = sums[shard] + more if shard in sums else more.astype(np.float64)
        cols = [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["shard", "sums"])

    fields = "shard int, sums binary"
    found = blocks.select(*columns).mapInArrow(count, fields).repartition(SHARDS, "shard").mapInArrow(add, fields)
    total = np.zeros((2, size * SHARDS, CLASSES))
    for row in found.toLocalIterator():  # at most SHARDS rows of fixed size
        total[:, row["shard"] * size : (row["shard"] + 1) * size] = np.frombuffer(row["sums"]).reshape(2, size, CLASSES)
    return total[0, :WEIGHT_ROWS], total[1, :WEIGHT_ROWS]


def train_classes(blocks: DataFrame, classes: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the class model: rounds of distributed updates over disjoint blocks."""
    weights = np.zeros((WEIGHT_ROWS, CLASSES), np.float32)
    for turn in range(rounds):
        observed, expected = _summed(blocks.filter(F.pmod(F.xxhash64("block"), F.lit(rounds)) == turn), classes, weights)
        weights += (STEP / ACTIVE * np.log((observed + PRIOR) / (expected + PRIOR))).astype(np.float32)
    return weights


# ---------------------------------------------------------------- scoring


def _corpus_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a block cannot know: ``block, place, total`` of words that other blocks count too.

    Rows of one word meet by its hash, one from each block. The second table
    holds, by ending, the number of training tokens ``n`` and of distinct words ``v``.
    """
    words_of = blocks.select("block", F.posexplode(F.arrays_zip("codes", "endings", "counts")).alias("place", "w"))
    words_of = words_of.select(
        F.col("w.codes").alias("code"),
        (F.shiftleft("block", PLACE_BITS) + F.col("place")).alias("at"),
        (F.shiftleft(F.col("w.counts").cast("long"), 16) + F.col("w.endings")).alias("own"),
    )
    # A word has at most one row per block, and its rows are only summed.
    same = Window.partitionBy("code")
    counted = F.shiftright("own", 16)
    rows = words_of.select(
        "at", "own", F.sum(counted).over(same).alias("all"), F.min(F.when(counted > 0, F.col("at"))).over(same).alias("first")
    )
    group = F.col("own").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("ending")
    rows = stored(rows.filter((F.col("all") != counted) | (F.col("first") == F.col("at"))), "counts")
    differs = rows.filter(F.col("all") != counted).select(
        F.shiftright("at", PLACE_BITS).alias("block"),
        F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int").alias("place"),
        F.col("all").alias("total"),
    )
    # A word's first row stands for it, with its count over all blocks.
    by_ending = rows.filter(F.col("first") == F.col("at")).groupBy(group).agg(F.sum("all").alias("n"), F.count(F.lit(1)).alias("v"))
    return differs, by_ending


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Scores are log10 probabilities of whole texts, the end included; null and
    empty texts are an end alone. Without training rows every word is unknown.
    Rows are kept as they are, repeated ones too; other columns are ignored.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("train", ~_held_out())
    tokens = tokenized(texts)
    blocks = tokens.filter("block IS NOT NULL")
    pairs = tokens.filter("cells IS NOT NULL").select(F.explode(F.arrays_zip("cells", "pairs")).alias("p"))
    pairs = pairs.groupBy("p.cells").agg(F.sum("p.pairs").alias("n")).toArrow()  # at most (ENDINGS + 1)^2 rows
    classes = cluster_endings(pairs.column("cells").to_numpy(), pairs.column("n").to_numpy())
    weights = train_classes(blocks, classes)

    counts, by_ending = _corpus_counts(blocks)
    by_class = np.zeros((2, CLASSES))
    for row in by_ending.collect():  # at most ENDINGS + 1 rows
        by_class[:, classes[row["ending"]]] += row["n"], row["v"]
    n_all, v_all = int(by_class[0].sum()), int(by_class[1].sum())
    model = spark.sparkContext.broadcast((classes, weights, by_class))
    kind = df.schema[id_col].dataType.simpleString()
    out = f"id {kind}, n_tokens long, n_known long, base_score double, score double"
    columns = ["lengths", "tokens", "codes", "endings", "counts"]

    def run(own: pa.Table, more: pa.Table) -> pa.Table:
        classes, weights, (n_class, v_class) = model.value
        found = []
        for batch in own.to_batches():
            for i, block in enumerate(_blocks(batch, columns)):
                count, group = np.array(block["counts"], np.int64), np.asarray(block["endings"])
                count[more.column("place").to_numpy()] = more.column("total").to_numpy()
                base = np.log10((count + ADDED) / (n_all + ADDED * (v_all + 1)))
                cls = classes[group]
                total, kinds = n_class[cls], v_class[cls]
                held = np.where(count > 0, count - DISCOUNT, DISCOUNT * kinds)
                inner = np.where(total > 0, np.log10(np.maximum(held, 1e-300) / np.maximum(total, 1)), 0.0)
                inner[cls == END_CLASS] = 0.0
                ids = batch.column("ids")[i].values
                for t, place, which in _batches_of(block, classes, only_training=False):
                    active, target = features(t, classes), cls[place]
                    chosen = np.empty(len(place))
                    for k in range(0, len(place), BATCH_TOKENS):
                        logs = log_classes(active[:, k : k + BATCH_TOKENS], weights)
                        chosen[k : k + BATCH_TOKENS] = logs[np.arange(len(logs)), target[k : k + BATCH_TOKENS]]
                    sums = [
                        np.add.reduceat(x, t.start)
                        for x in ((count[place] > 0).astype(np.int64), base[place], chosen / np.log(10) + inner[place])
                    ]
                    cols = [ids.slice(which.start, which.stop - which.start), pa.array(t.length), *map(pa.array, sums)]
                    found.append(pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(found) if found else _no_rows(own)

    left = blocks.select(F.col("block").alias("own_block"), "ids", *columns)
    found = left.groupBy("own_block").cogroup(counts.groupBy("block")).applyInArrow(run, out)
    return found.select(
        F.col("id").alias(id_col), _held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _no_rows(own: pa.Table) -> pa.Table:
    ids = own.schema.field("ids").type.value_type
    kinds = [("id", ids), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    return pa.Table.from_batches([], pa.schema(kinds))


@query("op5_maxent_scores")
def op5_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
